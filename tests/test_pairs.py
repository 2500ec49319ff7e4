import datetime as dt

from factloom.streaming import pairs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


TOKENS = [(1, 100, at(0)), (1, 101, at(300)), (2, 200, at(10)), (2, 201, at(10)), (None, 300, at(0)), (3, 400, at(719)), (3, 401, at(2000))]
#: activity doesn't prolong: user 1's last token ends at 300 + 720
ACTIVITY = [(k, u, at(m)) for k, (u, m) in enumerate([(1, 0), (1, 299), (1, 300), (1, 719), (1, 1019), (1, 1020), (2, 9), (2, 10), (2, 729), (2, 730), (None, 5), (3, 1438), (3, 1439), (4, 1), (1, -1), (1, 300)])]
WANT = {0: 100, 1: 100, 2: 101, 3: 101, 4: 101, 5: None, 6: None, 7: 201, 8: 201, 9: None, 10: None, 11: 400, 12: None, 13: None, 14: None, 15: 101}
A, K = "event_id long, user_id long, ts timestamp", "user_id long, token_id long, issued timestamp"


def run_stream(spark, df, out, tmp):
    df.writeStream.format("parquet").option("path", f"{tmp}/{out}").option("checkpointLocation", f"{tmp}/{out}-c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp}/{out}")


def streams(spark, tmp, **tables):
    """Each table as a stream of files: all rows, then a late row that moves the watermark on."""
    out = []
    for name, (rows, shape, late) in tables.items():
        for k, part in enumerate((rows, late)):
            spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{tmp}/{name}")
        out.append(spark.readStream.schema(spark.read.parquet(f"{tmp}/{name}").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/{name}"))
    return out


def test_tokens_live_a_fixed_time(spark, tmp_path):
    activity, tokens = spark.createDataFrame(ACTIVITY, A), spark.createDataFrame(TOKENS, K)
    got = pairs.newest_token(activity, tokens)
    assert got.columns == ["event_id", "user_id", "ts", "token_id", "issued"]
    assert {r.event_id: r.token_id for r in got.collect()} == WANT and got.count() == len(ACTIVITY)
    every = pairs.under_tokens(activity, tokens)
    newest = {}
    for r in every.collect():
        newest[r.event_id] = max(newest.get(r.event_id) or 0, r.token_id or 0) or None
    assert newest == WANT
    assert pairs.newest_token(activity.limit(0), tokens).count() == 0 and pairs.newest_token(activity, tokens.limit(0)).where("token_id IS NULL").count() == len(ACTIVITY)
    end = at(100_000)
    a, t = streams(spark, tmp_path, a=(ACTIVITY, A, [(99, 9, end)]), t=(TOKENS, K, [(9, 999, end)]))
    streamed = run_stream(spark, pairs.under_tokens(a, t, late="30 minutes"), "out", tmp_path)
    key = lambda df: sorted((r.event_id, r.token_id or 0) for r in df.where("event_id < 99").collect())
    assert key(streamed) == key(every)


def test_requests_meet_their_answers(spark, tmp_path):
    requests = [("a", at(0), "GET"), ("b", at(1), "GET"), ("c", at(2), "POST"), ("d", at(3), "GET"), (None, at(4), "GET"), ("a2", at(5), "GET")]
    responses = [("a", at(0) + dt.timedelta(milliseconds=250), 200), ("b", at(12), 500), ("c", at(12), 201), (None, at(4), 200), ("d", at(2), 200)]
    q, s = "request_id string, ts timestamp, method string", "request_id string, ts timestamp, status int"
    table = pairs.answered(spark.createDataFrame(requests, q), spark.createDataFrame(responses, s))
    got = {r.request_id: (r.duration_ms, r.status) for r in table.collect()}
    assert got == {"a": (250, 200), "b": (None, None), "c": (600_000, 201), "d": (None, None), None: (None, None), "a2": (None, None)}
    left, right = streams(spark, tmp_path, q=(requests, q, [("z", at(9_999), "GET")]), s=(responses, s, [("z", at(9_999), 200)]))
    streamed = run_stream(spark, pairs.answered(left, right, late="30 minutes"), "out", tmp_path)
    assert {r.request_id: (r.duration_ms, r.status) for r in streamed.where("request_id IS NULL OR request_id <> 'z'").collect()} == got
