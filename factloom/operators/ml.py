"""Classifiers over training records: TF-IDF and naive Bayes as relations, others by pyspark.ml.

Relational forms keep (doc_id, term, weight) rows, never a dense matrix.
"""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from factloom.functions import lexicons as L
from factloom.functions import text as X

#: Stop words unless others are given: those of the articles' keywords and of the training data.
STOP = sorted({*L.STOP_WORDS, *L.TRAINING_STOP_WORDS})
MIN_ROWS = 20
#: Terms of documents that a task of a pass takes, at least.
PASS_ENTRIES = 1 << 20


# ---------------------------------------------------------------- Porter's stemmer (1980)


class Porter:
    """The algorithm of the paper, by its steps."""

    def _consonant(self, w: str, i: int) -> bool:
        if w[i] in "aeiou":
            return False
        return True if w[i] != "y" else i == 0 or not self._consonant(w, i - 1)

    def _measure(self, w: str) -> int:
        kinds = "".join("c" if self._consonant(w, i) else "v" for i in range(len(w)))
        return sum(kinds[i : i + 2] == "vc" for i in range(len(kinds)))

    def _vowel(self, w: str) -> bool:
        return any(not self._consonant(w, i) for i in range(len(w)))

    def _double(self, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and self._consonant(w, len(w) - 1)

    def _cvc(self, w: str) -> bool:
        n = len(w)
        return n > 2 and self._consonant(w, n - 3) and not self._consonant(w, n - 2) and self._consonant(w, n - 1) and w[-1] not in "wxy"

    # Suffixes of steps 2, 3 and 4.
    STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

    def _swap(self, w: str, table: dict[str, str]) -> str:
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                base = w[: -len(end)]
                return base + table[end] if self._measure(base) > 0 else w
        return w

    def stem(self, w: str) -> str:
        if len(w) <= 2:
            return w
        for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(end):
                w = w[: -len(end)] + new
                break
        cut = False
        if w.endswith("eed"):
            w = w[:-1] if self._measure(w[:-3]) > 0 else w
        elif w.endswith("ed") and self._vowel(w[:-2]):
            w, cut = w[:-2], True
        elif w.endswith("ing") and self._vowel(w[:-3]):
            w, cut = w[:-3], True
        if cut:
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif self._double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif self._measure(w) == 1 and self._cvc(w):
                w += "e"
        if w.endswith("y") and self._vowel(w[:-1]):
            w = w[:-1] + "i"
        w = self._swap(self._swap(w, self.STEP2), self.STEP3)
        for end in sorted(self.STEP4, key=len, reverse=True):
            if w.endswith(end):
                base = w[: -len(end)]
                if self._measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                    w = base
                break
        if w.endswith("e"):
            m = self._measure(w[:-1])
            if m > 1 or m == 1 and not self._cvc(w[:-1]):
                w = w[:-1]
        if self._measure(w) > 1 and self._double(w) and w.endswith("l"):
            w = w[:-1]
        return w


def stem(words: Column, least: int = 0, stop: list[str] | None = None) -> Column:
    """Stems of an array of words, in Arrow batches, each distinct word once a batch; those shorter than ``least`` or in ``stop`` are left out.

    ``words`` is a column of a table, not what ``terms`` makes in the same step:
    Spark doesn't take Python out of the nested lambdas of such an expression.
    """
    banned = frozenset(stop or ())

    def run(batch: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}
        porter = Porter()
        out = []
        for ws in batch:
            for w in ws:
                if w not in known:
                    s = porter.stem(w)
                    known[w] = None if len(s) < least or s in banned else s
            out.append([known[w] for w in ws if known[w] is not None])
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.ArrayType(T.StringType()))(words)


def terms(text: Column, stop: list[str] | None = None) -> Column:
    """Normal words of at least three letters that are no stop words or numbers."""
    stop = STOP if stop is None else [*stop, *L.TRAINING_STOP_WORDS]
    return F.filter(F.split(X.normal_text(text), " "), lambda w: (F.length(w) >= 3) & ~w.isin(stop) & ~w.rlike(r"^\d+$"))


def stem_counts(docs: DataFrame, text: Column) -> DataFrame:
    """stem, n: stems of the ``terms`` of all texts; stems too have three letters and are no stop words.

    Words are counted before, so Python sees each distinct word once, and no text.
    """
    words = docs.select(F.explode_outer(terms(text)).alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    stems = words.select("n", F.explode(stem(F.array("word"), 3, STOP)).alias("stem"))
    return stems.groupBy("stem").agg(F.sum("n").alias("n"))


def grams(words: str) -> Column:
    """Words and pairs of neighbours.  Take them apart by ``explode_outer``: a plain ``explode`` makes them twice, as it first asks whether there are any."""
    pairs = F.zip_with(F.col(words), F.slice(words, 2, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.concat(F.col(words), F.filter(pairs, lambda p: p.isNotNull()))


# ---------------------------------------------------------------- relations


def shared_path(spark, tag: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); a local one only where both are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/factloom-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: used often, computed once, and no lineage to repeat."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split(records: DataFrame, key: str = "doc_id", percent: int = 80, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """``in_train``: stratified by label, the first ``percent`` of each label by a hash of the id.

    Rows are counted by label and range of the hash; only the range that a
    label's cut falls in ranks its rows one by one, so no label passes one task.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    dealt = records.withColumns({"_h": h, "_range": F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("double") * (buckets / 2.0**32)).cast("int")})
    counts = dealt.groupBy("label", "_range").agg(F.count(F.lit(1)).alias("_c"))
    by_label = W.partitionBy("label")  # at most ``buckets`` rows each
    counts = counts.withColumns({"_before": F.sum("_c").over(by_label.orderBy("_range")) - F.col("_c"), "_n": F.sum("_c").over(by_label)})
    placed = dealt.join(counts, ["label", "_range"])
    inside, cut = W.partitionBy("label", "_range").orderBy("_h", key), F.floor(F.col("_n") * percent / 100)
    whole = F.col("_before") + F.col("_c") <= cut
    border = placed.where(~whole & (F.col("_before") < cut)).withColumn("_place", F.col("_before") + F.row_number().over(inside))
    rest = placed.where(whole | (F.col("_before") >= cut)).withColumn("_place", F.when(whole, 0).otherwise(F.col("_n")).cast("long"))
    both = rest.unionByName(border)
    return both.withColumn("in_train", (F.col("_place") == 0) | ((F.col("_place") <= cut) & (F.col("_before") < cut))).drop("_h", "_range", "_c", "_before", "_n", "_place")


def fit_tfidf(docs: DataFrame, min_df: int = 2, max_share: float = 0.97) -> DataFrame:
    """term, idf: of terms in at least ``min_df`` documents and at most that share; expects ``words``."""
    df = docs.select(F.explode_outer(F.array_distinct(grams("words"))).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    kept = df.crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n_docs")))  # n is one row
    return kept.select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def weigh(docs: DataFrame, idf: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, weight: (1 + ln tf) idf over known terms, of norm 1 for each document; expects ``words``."""
    tf = docs.select(key, F.explode_outer(grams("words")).alias("term")).where("term IS NOT NULL").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def tfidf(docs: DataFrame, key: str = "doc_id", min_df: int = 2, max_share: float = 0.97) -> DataFrame:
    """``weigh`` of the documents that also give the document frequencies."""
    return weigh(docs, fit_tfidf(docs, min_df, max_share), key)


def naive_bayes_weights(weights: DataFrame, records: DataFrame, key: str = "doc_id", alpha: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes over tf-idf weights: (label, term, gain) and (label, prior, unseen).

    ``gain`` is what a term adds beyond ``unseen``, the log probability of a term
    that the label has not.
    """
    sums = weights.join(records.select(key, "label"), key).groupBy("label", "term").agg(F.sum("weight").alias("w"))
    size = sums.agg(F.count_distinct("term").alias("v"))
    totals = sums.groupBy("label").agg(F.sum("w").alias("total")).crossJoin(F.broadcast(size))  # one row
    n = records.agg(F.count(F.lit(1)).alias("n"))
    priors = records.groupBy("label").agg(F.count(F.lit(1)).alias("n_l")).crossJoin(F.broadcast(n))  # one row
    whole = F.col("total") + alpha * F.col("v")
    labels = priors.join(totals, "label").select("label", F.log(F.col("n_l") / F.col("n")).alias("prior"), F.log(F.lit(alpha) / whole).alias("unseen"))
    return sums.select("label", "term", F.log((F.col("w") + alpha) / F.lit(alpha)).alias("gain")), labels


def naive_bayes_scores(weights: DataFrame, docs: DataFrame, model: tuple[DataFrame, DataFrame], key: str = "doc_id") -> DataFrame:
    """key, label, score of each label (few rows) for each document; terms outside the vocabulary are passed over."""
    gains, labels = model
    known = weights.join(gains.select("term").distinct(), "term", "left_semi")
    size = known.groupBy(key).agg(F.sum("weight").alias("w"))
    base = docs.select(key).join(size, key, "left").crossJoin(F.broadcast(labels))  # one row for each label
    extra = known.join(gains, "term").groupBy(key, "label").agg(F.sum(F.col("weight") * F.col("gain")).alias("gain"))
    return base.join(extra, [key, "label"], "left").select(key, "label", (F.col("prior") + F.coalesce("w", F.lit(0.0)) * F.col("unseen") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def best_label(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, predicted, probability: softmax over the labels' scores; ties go to the label that is first by name."""
    per = scores.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-X.js_round(F.col("score"), 9)).alias("s"), "label"))).alias("x"))
    top = F.col("x")[0]
    total = F.aggregate("x", F.lit(0.0), lambda a, y: a + F.exp(top["s"] - y["s"]))
    return per.select(key, top["label"].alias("predicted"), (1 / total).alias("probability"))


def naive_bayes_counts(train: DataFrame, alpha: float = 1.0) -> DataFrame:
    """label, term, log_p from counts; expects ``words`` and label."""
    counts = train.select("label", F.explode_outer(grams("words")).alias("term")).where("term IS NOT NULL").groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    size = counts.agg(F.count_distinct("term").alias("v"))
    return counts.join(F.broadcast(totals), "label").crossJoin(F.broadcast(size)).withColumn("log_p", F.log((F.col("n") + alpha) / (F.col("total") + alpha * F.col("v")))).select("label", "term", "n", "total", "v", "log_p")


def naive_bayes_predict(docs: DataFrame, model: DataFrame, train: DataFrame, key: str = "doc_id", alpha: float = 1.0) -> DataFrame:
    """key, predicted, score: each document's best label; terms outside the vocabulary are passed over.

    A term unseen with a label costs log(alpha / (total + alpha v)), so each
    label's sum is over all known terms.  Labels are few and fixed.
    """
    tf = docs.select(key, F.explode_outer(grams("words")).alias("term")).where("term IS NOT NULL").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = model.select("term").distinct()
    known = tf.join(vocabulary, "term", "left_semi")
    labels = model.groupBy("label").agg(F.max("total").alias("total"), F.max("v").alias("v"))
    priors = train.groupBy("label").agg(F.count(F.lit(1)).alias("n_l"))
    n = train.agg(F.count(F.lit(1)).alias("n_all"))
    labels = labels.join(priors, "label").crossJoin(n).select("label", F.log(F.lit(alpha) / (F.col("total") + alpha * F.col("v"))).alias("unseen"), F.log(F.col("n_l") / F.col("n_all")).alias("prior"))
    size = known.groupBy(key).agg(F.sum("tf").alias("n_tokens"))
    base = docs.select(key).join(size, key, "left").crossJoin(F.broadcast(labels))  # one row for each label
    extra = known.join(model.select("label", "term", "log_p"), "term").join(F.broadcast(labels), "label").groupBy(key, "label").agg(F.sum(F.col("tf") * (F.col("log_p") - F.col("unseen"))).alias("gain"))
    scored = base.join(extra, [key, "label"], "left").select(key, "label", (F.col("prior") + F.coalesce("n_tokens", F.lit(0)) * F.col("unseen") + F.coalesce("gain", F.lit(0.0))).alias("score"))
    best = scored.groupBy(key).agg(F.max_by("label", F.struct(X.js_round(F.col("score"), 6).alias("s"), "label")).alias("predicted"), F.max("score").alias("score"))
    return best


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def metrics(cells: DataFrame, labels: list[str]) -> DataFrame:
    """accuracy, macro precision, recall, F1 from confusion cells: one row."""
    sums = [F.sum(F.when((F.col("label") == a) & (F.col("predicted") == b), F.col("n")).otherwise(0)).alias(f"c_{i}_{j}") for i, a in enumerate(labels) for j, b in enumerate(labels)]
    one = cells.agg(*sums, F.sum("n").alias("n"))
    k = range(len(labels))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = [F.col(f"c_{i}_{i}") for i in k]
    pred = [sum((F.col(f"c_{j}_{i}") for j in k), F.lit(0)) for i in k]
    real = [sum((F.col(f"c_{i}_{j}") for j in k), F.lit(0)) for i in k]
    p, r = [ratio(tp[i], pred[i]) for i in k], [ratio(tp[i], real[i]) for i in k]
    f = [F.when(p[i] + r[i] > 0, 2 * p[i] * r[i] / (p[i] + r[i])).otherwise(0.0) for i in k]
    mean = lambda xs: X.js_round(sum(xs, F.lit(0.0)) / len(labels), 4)
    return one.select("n", X.js_round(sum(tp, F.lit(0)) / F.greatest("n", F.lit(1)), 4).alias("accuracy"), mean(p).alias("precision"), mean(r).alias("recall"), mean(f).alias("f1"))


def class_report(cells: DataFrame, labels: list[str]) -> DataFrame:
    """label, precision, recall, f1, support of each label, then of their plain and weighted means ('macro avg', 'weighted avg')."""
    each = cells.where(F.col("label").isin(labels) & F.col("predicted").isin(labels))
    axis = F.array(F.struct(F.col("label").alias("l"), F.lit(1).alias("real")), F.struct(F.col("predicted").alias("l"), F.lit(0).alias("real")))
    sides = each.select("n", (F.col("label") == F.col("predicted")).alias("hit"), F.explode(axis).alias("x")).groupBy("x.l").agg(F.sum(F.when(F.col("x.real") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.real") == 0, F.col("n")).otherwise(0)).alias("said"), F.sum(F.when(F.col("hit") & (F.col("x.real") == 1), F.col("n")).otherwise(0)).alias("tp"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    per = sides.select(F.col("l").alias("label"), ratio("tp", "said").alias("precision"), ratio("tp", "support").alias("recall"), "support")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    total = F.sum("support").alias("support")
    macro = per.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total).withColumn("label", F.lit("macro avg"))
    weighed = per.agg(*[(F.sum(F.col(c) * F.col("support")) / F.greatest(F.sum("support"), F.lit(1))).alias(c) for c in ("precision", "recall", "f1")], total).withColumn("label", F.lit("weighted avg"))
    out = per.unionByName(macro).unionByName(weighed)
    return out.select("label", *[X.js_round(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def best_model(rows: DataFrame) -> DataFrame:
    """By f1, accuracy, precision; the first registered wins ties.  Expects place."""
    return rows.orderBy(F.col("f1").desc(), F.col("accuracy").desc(), F.col("precision").desc(), "place").limit(1)


# ---------------------------------------------------------------- pyspark.ml


def places(idf: DataFrame) -> DataFrame:
    """term, place: terms numbered from 0."""
    # numbers without a window over everything: an offset for each of some ranges of a hash, and ranks inside
    dealt = idf.select("term", F.pmod(F.xxhash64("term"), F.lit(4096)).alias("_range"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # at most 4096 rows
    offsets = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_c")).select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy("term")) - 1
    return dealt.join(offsets, "_range").select("term", (F.col("_offset") + inside).alias("place"))


def vectors(weights: DataFrame, idf: DataFrame, docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, int]:
    """``docs`` with ``features``, a sparse vector over the terms of ``idf`` in the order of ``places``, and its size.

    A linear model has one coefficient for each term, so the vocabulary has to
    fit the driver here; ``naive_bayes_weights`` does without.
    """
    from pyspark.ml.linalg import SparseVector, VectorUDT

    place = places(idf)
    size = idf.count()
    packed = weights.join(place, "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("_x"))
    # two arrays of numbers: an array of structs makes a Row of each term in Python
    build = F.udf(lambda at, weight: SparseVector(size, at or [], weight or []), VectorUDT())
    return docs.join(packed, key, "left").withColumn("features", build("_x.place", "_x.weight")).drop("_x"), size


def linear_model(kind: str, train: DataFrame, n_labels: int = 2):
    """Logistic regression ('lr') or linear SVM ('svm', one against the rest for more than two labels) on ``features``, ``y``, ``weight``; penalised as C = 1."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest

    penalty = 1.0 / max(1, train.count())
    if kind == "lr":
        return LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=penalty, standardization=False, maxIter=200).fit(train)
    two = LinearSVC(featuresCol="features", labelCol="y", weightCol="weight", regParam=penalty, standardization=False, maxIter=60)
    return (two if n_labels == 2 else OneVsRest(classifier=two, featuresCol="features", labelCol="y", weightCol="weight")).fit(train)


class Calibrated:
    """Linear SVMs of ``folds`` folds, each with a sigmoid fitted on the rows that it hasn't seen; probabilities are their mean (two labels, y = 0, 1)."""

    def __init__(self, train: DataFrame, key: str = "doc_id", folds: int = 5):
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector, vector_to_array

        fold = F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(folds))
        self.parts = []
        for k in range(folds):
            svm = linear_model("svm", train.where(fold != k))
            margin = svm.transform(train.where(fold == k)).select("y", array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("margin"))
            # targets drawn in, as a margin's sign can be certain on few rows
            n = margin.groupBy("y").count().collect()
            if len(n) < 2:
                continue
            sigmoid = LogisticRegression(featuresCol="margin", labelCol="y", regParam=1e-6, standardization=False).fit(margin)
            self.parts.append((svm, float(sigmoid.coefficients[0]), float(sigmoid.intercept)))

    def probabilities(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """``docs`` with ``probability`` of y = 1."""
        from pyspark.ml.functions import vector_to_array

        out, names = docs, []
        for k, (svm, slope, offset) in enumerate(self.parts):
            raw = svm.transform(out).withColumn(f"_p{k}", 1 / (1 + F.exp(-(vector_to_array("rawPrediction")[1] * slope + offset))))
            out = raw.drop("rawPrediction", "prediction", "probability")
            names.append(f"_p{k}")
        mean = sum((F.col(n) for n in names), F.lit(0.0)) / max(1, len(names))
        return out.withColumn("probability", mean).drop(*names)


def gathered(train: DataFrame, entries: int) -> DataFrame:
    """``train`` in as many partitions as passes over it are worth: each task of a pass sends a gradient as long as the vocabulary, so small ones cost more than they save.

    ``entries``: terms of all its documents.  All rows stay; where they are many, the cores share them.
    """
    return train.coalesce(max(1, min(train.sparkSession.sparkContext.defaultParallelism, -(-entries // PASS_ENTRIES))))


def balanced(train: DataFrame) -> DataFrame:
    """``weight``: rows / (classes * rows of the class)."""
    per = train.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return train.join(F.broadcast(per.crossJoin(total)), "y").withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def decide(best: Column, label: Column, margin: Column, n_tokens: Column, threshold: float = 0.72) -> Column:
    """Short texts, low probabilities and close calls are UNCERTAIN."""
    return F.when((n_tokens < 25) | (best < threshold) | (margin < 0.06), "UNCERTAIN").otherwise(label)


def explain(weights: DataFrame, coefficients: DataFrame, key: str = "doc_id", most: int = 8) -> DataFrame:
    """key, term, impact, direction: the terms that weigh most for the predicted label."""
    hit = weights.join(coefficients, "term").withColumn("impact", F.col("weight") * F.col("coefficient"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.abs("impact").desc(), "term"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "term", "impact", F.when(F.col("impact") >= 0, "supports").otherwise("opposes").alias("direction"), "rank")


def top_coefficients(model: DataFrame, most: int = 20) -> DataFrame:
    """label, term, gain, rank: the terms that speak most for each label, of (label, term, gain)."""
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.col("gain").desc(), "term"))
    return model.withColumn("rank", rank).where(F.col("rank") <= most)


def version(model_id: str, generated_at: str) -> str:
    digits = "".join(c for c in generated_at if c.isdigit())
    return f"{model_id}-{digits[:8]}-{digits[8:14]}"


# ---------------------------------------------------------------- life cycle

#: id and name of the candidates, in the order in which ties are won (fixed values).
CANDIDATES = {"multinomial_naive_bayes": "Multinomial Naive Bayes", "logistic_regression": "Logistic Regression", "linear_svm": "Linear SVM"}


def compare(records: DataFrame, labels: list[str], key: str = "doc_id", min_df: int = 2, kinds: tuple[str, ...] = tuple(CANDIDATES)) -> dict[str, DataFrame]:
    """Confusion cells (label, predicted, n) of each candidate on the rows that aren't ``in_train``; expects words, label, in_train."""
    train, test = records.where("in_train"), records.where("NOT in_train")
    if train.count() < MIN_ROWS:
        raise ValueError(f"fewer than {MIN_ROWS} rows to train on")
    idf = written(fit_tfidf(train, min_df), "idf")
    out = {}
    if "multinomial_naive_bayes" in kinds:
        model = naive_bayes_weights(weigh(train, idf, key), train, key)
        said = best_label(naive_bayes_scores(weigh(test, idf, key), test, model, key), key)
        out["multinomial_naive_bayes"] = confusion(test.select(key, "label").join(said, key))
    linear = {"lr": "logistic_regression", "svm": "linear_svm"}
    wanted = [k for k, name in linear.items() if name in kinds]
    if wanted:
        weights = written(weigh(records, idf, key), "weights")
        if len(labels) == 2:
            from factloom.operators import dual

            cells = dual.confusions(weights, records, labels, wanted, key)
        else:
            cells = {}
            code = F.create_map(*[F.lit(v) for i, k in enumerate(labels) for v in (k, float(i))])
            name = F.create_map(*[F.lit(v) for i, k in enumerate(labels) for v in (float(i), k)])
            rows, _ = vectors(weights, idf, records.withColumn("y", code[F.col("label")]).select(key, "label", "y", "in_train"), key)
            rows = written(rows, "vectors")  # not cached: a lost executor would make them anew
            fitted, held = balanced(gathered(rows.where("in_train"), weights.count())), rows.where("NOT in_train")
            for k in wanted:
                cells[k] = confusion(linear_model(k, fitted, len(labels)).transform(held).select("label", name[F.col("prediction")].alias("predicted")))
        out |= {linear[k]: c for k, c in cells.items()}
    return out


def comparison(cells: dict[str, DataFrame], labels: list[str]) -> DataFrame:
    """place, id, name, n, accuracy, precision, recall, f1 of each candidate, and ``best``."""
    rows = None
    for i, (k, c) in enumerate(cells.items()):
        one = metrics(c, labels).select(F.lit(list(CANDIDATES).index(k)).alias("place"), F.lit(k).alias("id"), F.lit(CANDIDATES[k]).alias("name"), "*")
        rows = one if rows is None else rows.unionByName(one)
    first = rows.agg(F.max_by("place", F.struct("f1", "accuracy", "precision", (-F.col("place")).alias("p"))).alias("_best"))
    return rows.crossJoin(F.broadcast(first)).withColumn("best", F.col("place") == F.col("_best")).drop("_best")  # one row


def training_payload(cells: dict[str, DataFrame], labels: list[str], generated_at: str, sizes: dict[str, int]) -> dict:
    """Metrics of all candidates, the report and the card of the best (bounded: a few rows for each candidate)."""
    table = {r.id: r.asDict() for r in comparison(cells, labels).collect()}
    for k, r in table.items():
        got = {(c.label, c.predicted): c.n for c in cells[k].collect()}
        r["confusion_matrix"] = {a: {b: got.get((a, b), 0) for b in labels} for a in labels}
        r["classification_report"] = {c.label: {"precision": c.precision, "recall": c.recall, "f1": c.f1, "support": c.support} for c in class_report(cells[k], labels).collect()}
        r["model_version"] = version(k, generated_at)
    best = next(r for r in table.values() if r["best"])
    config = {"lowercase": True, "remove_urls": True, "remove_punctuation": True, "remove_stopwords": True, "vectorizer": "TF-IDF", "ngram_range": [1, 2], "min_df": 2, "max_df": 0.97, "sublinear_tf": True}
    report = {"best_model": best["name"], "model_version": best["model_version"], **{c: best[c] for c in ("accuracy", "precision", "recall", "f1", "confusion_matrix")}, "dataset_size": sizes["total"], "test_size": sizes["test"]}
    card = {"model_name": best["name"], "model_id": best["id"], "model_version": best["model_version"], "generated_at": generated_at, "training_samples": sizes["train"], "test_samples": sizes["test"], "preprocessing": config, "decision_policy": {"confidence_threshold": 0.72, "low_confidence_label": "UNCERTAIN"}}
    return {"generated_at": generated_at, "labels": labels, "models": table, "best": best["id"], "report": report, "card": card}


def save_naive_bayes(model: tuple[DataFrame, DataFrame], idf: DataFrame, path: str) -> None:
    """The model as three tables: gains, labels, idf."""
    for name, df in (("gains", model[0]), ("labels", model[1]), ("idf", idf)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_naive_bayes(spark, path: str) -> tuple[tuple[DataFrame, DataFrame], DataFrame]:
    gains, labels, idf = (spark.read.parquet(f"{path}/{name}") for name in ("gains", "labels", "idf"))
    return (gains, labels), idf
