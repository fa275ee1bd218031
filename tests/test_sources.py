import datetime as dt

from pyspark.sql import functions as F

from fleetlens.sources.chunks import (chunk_record, llm_requests, parse_llm_chunks, parse_llm_log_lines,
                                      request_model, running_models)
from fleetlens.sources.gpu import gpu_process_list, normalise_device_samples, parse_gpu_csv
from fleetlens.sources.stored import parse_stored_times


def _csv(spark, lines):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i int, value string")
    return {r["i"]: r for r in parse_gpu_csv(df).collect()}


def test_parse_probe_line(spark):
    got = _csv(spark, ["3, Accelerator X9, 71, 22, 6000, 24000, 58, 199.9"])[0]
    assert (got["gpu_id"], got["name"], got["utilization_gpu"], got["utilization_memory"], got["temperature"]) == \
        (3, "Accelerator X9", 71, 22, 58)
    assert got["memory_used"] == 6000 * 1048576 and got["memory_total"] == 24000 * 1048576
    assert got["power_usage"] == 199


def test_unsigned_ranges(spark):
    """Readings above a signed 32-bit value stay; above the unsigned one the line goes, and power saturates."""
    rows = _csv(spark, ["0,A,1,1,1,1,3000000000,5", "4294967295,B,1,1,1,1,1,3e9", "4294967296,C,1,1,1,1,1,1",
                        "7,D,1,1,1,1,4294967296,1", "8,E,1,1,1,1,1,9e9"])
    got = {r["gpu_id"]: r for r in rows.values()}
    assert got[0]["temperature"] == 3000000000 and got[4294967295]["power_usage"] == 3000000000
    assert got[8]["power_usage"] == 4294967295 and len(got) == 3


def test_counts_above_bigint_keep_the_record(spark):
    from fleetlens.sources.chunks import parse_llm_chunks, stored_counts
    line = '{"model":"m","created_at":"c","done":true,"eval_count":%s}'
    counts = ["18446744073709551615", "9223372036854775808", "5", "18446744073709551616", "-1", "1.5", "null"]
    raw = spark.createDataFrame([(i, line % c) for i, c in enumerate(counts)], "i int, chunk string")
    got = {r["i"]: r["eval_count"] for r in parse_llm_chunks(raw).collect()}
    assert got == {0: 18446744073709551615, 1: 9223372036854775808, 2: 5, 6: None}
    assert {r["i"]: r["eval_count"] for r in stored_counts(parse_llm_chunks(raw)).collect()} == {0: 2**63 - 1, 1: 2**63 - 1, 2: 5, 6: None}


def test_a_marker_cannot_be_forged(spark):
    import hashlib
    from fleetlens.sources.chunks import parse_llm_chunks
    good = '{"model":"m","created_at":"c","done":true}'
    forged = [good + ',"#end#"] x', good + ',"' + hashlib.sha256(good.encode()).hexdigest() + '"] x', good + "]", good + ",1"]
    raw = spark.createDataFrame([(i, t) for i, t in enumerate([good, *forged])], "i int, chunk string")
    assert [r["i"] for r in parse_llm_chunks(raw).collect()] == [0]


def test_long_fractions_and_weeks(spark):
    import pytest
    from fleetlens.operators.rollups import weekly_summary
    from fleetlens.sources.stored import rfc3339_to_timestamp
    got = spark.createDataFrame([("2024-01-01T00:00:00.1234567890123Z",)], "t string").select(rfc3339_to_timestamp("t").alias("t")).first()
    assert got["t"].microsecond == 123456
    with pytest.raises(ValueError, match="Monday"):
        weekly_summary(spark.createDataFrame([], "timestamp timestamp, category string"), week="2024-01-02")


def test_request_body_bound_counts_bytes(spark):
    from fleetlens.sources.chunks import llm_requests
    log = spark.createDataFrame([("a", None, "/api/chat", 200, "é" * 6)], "request_key string, ts timestamp, path string, status int, body string")
    assert llm_requests(log, max_body=11).count() == 0 and llm_requests(log, max_body=12).count() == llm_requests(log, max_body=None).count() == 1


def test_fixed_rounds_the_exact_binary_value(spark):
    from decimal import ROUND_HALF_UP, Decimal
    from pyspark.sql import functions as F
    from fleetlens.functions.display import fixed
    values = [12.35, 0.15, 0.25, 0.35, 2.5, 3.5, 12.25, 1e-9, 0.0, 99.95, 123456789.05, 0.05, 1.0, 59.99999, 1234567.75]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        got = [r[0] for r in df.select(fixed("v", digits)).collect()]
        assert got == [str(Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values]


def test_probe_edge_rows(spark):
    lines = [
        "0, a, 1, 2, 3, 4, 5",                 # 7 fields: dropped
        "1, b, 1, 2, 3, 4, 5, 6, extra",       # 9 fields: extra ignored
        "2, c, 1, 2, 3, 4, 5, [N/A]",          # unparsable power: dropped
        "3, d, -3, 2, 3, 4, 5, 6",             # negative utilisation: dropped
        "4, e, +7, 2, 3, 4, 5, 6",             # leading + accepted
        "5,\tf\t,\t1\t, 2, 3, 4, 5, 6",        # tab padding trimmed
        "6, g, 12.5, 2, 3, 4, 5, 6",           # fractional utilisation: dropped
        "7, h, 1, 2, 3, 4, 5, -4.5",           # negative power saturates to 0
    ]
    got = _csv(spark, lines)
    assert sorted(got) == [1, 4, 5, 7]
    assert got[4]["utilization_gpu"] == 7
    assert got[5]["name"] == "f" and got[5]["utilization_gpu"] == 1
    assert got[7]["power_usage"] == 0


def test_device_samples_and_process_list(spark):
    proc = "array<struct<pid:bigint,name:string,used_gpu_memory:bigint>>"
    raw = spark.createDataFrame([
        (dt.datetime(2024, 1, 1), 0, None, 10, 20, 1, 2, None, 1999, [(5, None, 10), (6, "b", None)], [(5, "a", 30)]),
        (dt.datetime(2024, 1, 1), 1, "x", None, 20, 1, 2, 40, None, None, None),
    ], "timestamp timestamp, gpu_index int, name string, utilization_gpu int, utilization_memory int, "
       f"memory_used long, memory_total long, temperature int, power_mw long, compute_processes {proc}, "
       f"graphics_processes {proc}")
    m = normalise_device_samples(raw).collect()
    assert len(m) == 1 and m[0]["name"] == "GPU 0" and m[0]["temperature"] == 0 and m[0]["power_usage"] == 1
    procs = gpu_process_list(raw).collect()[0]["processes"]
    assert [(p["pid"], p["name"], p["used_gpu_memory"]) for p in procs] == [(5, "a", 30), (5, "pid_5", 10), (6, "b", 0)]


def _rec(spark, line):
    df = spark.createDataFrame([(line,)], "l string")
    return df.select(chunk_record(F.col("l")).alias("r")).collect()[0]["r"]


def test_chunk_record_strictness(spark):
    ok = '{"model":"llama2","created_at":"2024-01-01T00:00:00Z","response":"Hi","done":false}'
    r = _rec(spark, ok)
    assert r["model"] == "llama2" and r["response"] == "Hi" and r["done"] is False
    bad = [
        '{"model":"m","created_at":"t"}',                                   # missing done
        '{"model":5,"created_at":"t","done":true}',                         # model not a string
        '{"model":"m","created_at":"t","done":true,"eval_count":-1}',       # negative count
        '{"model":"m","created_at":"t","done":true,"eval_count":1.0}',      # fractional count
        '{"model":"m","created_at":"t","done":true} trailing',              # trailing text
        '{"model":"m","created_at":"t","done":"yes"}',                      # done not boolean
        '{"model":"m","model":"n","created_at":"t","done":true}',           # duplicate key
        '',
    ]
    for line in bad:
        assert _rec(spark, line) is None, line
    assert _rec(spark, '{"model":"m","created_at":"t","done":true,"response":null}')["response"] is None


def test_parse_chunks_first_valid_line(spark):
    raw = spark.createDataFrame([
        ("s", 0, dt.datetime(2024, 1, 1), bytearray(b'garbage\n{"model":"a","created_at":"t","done":false}\n'
                                                   b'{"model":"b","created_at":"t","done":true}')),
        ("s", 1, dt.datetime(2024, 1, 1), bytearray(b'\xff\xfe')),
        ("s", 2, dt.datetime(2024, 1, 1), bytearray(b'')),
    ], "session_id string, seq long, arrival_ts timestamp, chunk binary")
    got = parse_llm_chunks(raw).collect()
    assert [(r["seq"], r["model"]) for r in got] == [(0, "a")]
    every = parse_llm_chunks(raw, all_lines=True).collect()
    assert [(r["seq"], r["line_no"], r["model"]) for r in every] == [(0, 0, "a"), (0, 1, "b")]


def test_request_model(spark):
    bodies = ['{"model": "llama2", "prompt": "hello"}', "", "{}", '{"model":null}', '{"model":""}',
              '{"model":1}', "{broken"]
    raw = [bytearray(b.encode()) for b in bodies] + [bytearray(b'{"model":"a\xff"}')]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, body binary")
    got = [r["m"] for r in df.select("i", request_model("body").alias("m")).orderBy("i").collect()]
    assert got == ["llama2", "unknown", "unknown", "unknown", "", "unknown", "unknown", "unknown"]


def test_requests_logs_and_models(spark):
    log = spark.createDataFrame([
        ("k1", dt.datetime(2024, 1, 1), "/api/generate", 200, bytearray(b'{"model":"a"}')),
        ("k2", dt.datetime(2024, 1, 1), "/api/tags", 200, bytearray(b'{"model":"a"}')),
        ("k3", dt.datetime(2024, 1, 1), "/api/chat", 500, bytearray(b'{"model":"a"}')),
    ], "request_key string, ts timestamp, path string, status int, body binary")
    assert [r["request_key"] for r in llm_requests(log).collect()] == ["k1"]
    lines = spark.createDataFrame([('{"model":"generate","created_at":"t","done":true}',),
                                   ('{"model":"x","created_at":"t","done":true}',)], "value string")
    assert [r["model"] for r in parse_llm_log_lines(lines).collect()] == ["generate"]
    snaps = spark.createDataFrame([(1, 200, '{"models":[{"name":"a"},{"name":"b"}]}'), (2, 503, '{"models":[]}'),
                                   (3, 200, '{"models":[{"name":1}]}'), (4, 200, '{"models":5}'),
                                   (5, 200, 'not json')], "t int, status int, body string")
    assert [(r["t"], r["model"]) for r in running_models(snaps).collect()] == [(1, "a"), (1, "b")]


def test_stored_times(spark):
    df = spark.createDataFrame([("a", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00"),
                                ("b", "2024-01-01", None), ("c", "2024-01-01T00:00:00.5Z", "bad")],
                               "id string, start_time string, end_time string")
    got = {r["id"]: r for r in parse_stored_times(df, ["start_time"], ["end_time"]).collect()}
    assert sorted(got) == ["a", "c"]
    assert got["a"]["end_time"] == got["a"]["start_time"]
    assert got["c"]["end_time"] is None


def test_fixed_prints_what_has_no_decimals(spark):
    from fleetlens.functions.display import fixed
    rows = [(float("nan"), "NaN"), (float("inf"), "Infinity"), (float("-inf"), "-Infinity"), (1e21, "1e+21"), (-2.5e30, "-2.5e+30"),
            (1e20, "100000000000000000000.0"), (123456789012345683968.0, "123456789012345683968.0"), (None, None), (0.25, "0.3"), (-7.0, "-7.0")]
    got = spark.createDataFrame(rows, "v double, want string").select(fixed("v", 1).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
