from pyspark.sql import functions as F

from fleetlens.functions.classify import classify
from fleetlens.operators.processes import library_flag, process_events

SCHEMA = "name string, command_line string, exe_path string, gpu_utilization int"


def _cat(spark, rows, roots=()):
    df = spark.createDataFrame(rows, SCHEMA)
    return [r["category"] for r in classify(df, roots).collect()]


def test_one_row_per_rule(spark):
    rows = [("ollama", "ollama runner --port 4100", "/opt/ollama/bin/ollama", 12),
            ("python3.11", "python3.11 -m torch.distributed.run finetune_all.py --lr 2e-5", "/usr/bin/python3.11", 97),
            ("python", "python vllm_worker.py --generate 128", None, 33)]
    assert _cat(spark, rows) == ["llm_inference", "ml_training", "llm_inference"]


def test_edge_rows(spark):
    rows = [
        ("Game.EXE", "Game.EXE", None, 60),           # .exe at 60: not above 60
        ("Game.EXE", "Game.EXE", None, 61),           # above 60
        ("python3", "python3 -m torch serve", None, 0),  # framework word first (Q3)
        ("python3", "python3 rapid.py", None, 0),      # 'api' inside 'rapid' but no ML keyword
        ("python3", "python3 model.py --rapid", None, 0),  # ML keyword + 'api' inside a word
        ("tool", "tool", "/a/b/x", 0),                 # under root /a/b
        ("tool", "tool", "/a/bc/x", 0),                # not under /a/b
        ("tool", "tool", "/a/b", 0),                   # the root itself
        ("tool", "tool", "/home/u/MyGame/bin", 0),     # 'game' in path at any load
        ("tool", "tool", None, 99),
        ("x.exe\n", "x", None, 99),                    # a final newline is not an .exe ending
        ("tool", "tool", "/a//b/x", 0),                # repeated separator: still under /a/b
    ]
    assert _cat(spark, rows, ["/a/b/"]) == [
        "general_compute", "gaming", "ml_training", "general_compute", "llm_inference",
        "gaming", "general_compute", "gaming", "gaming", "general_compute", "general_compute", "gaming"]


def test_library_flag_join_matches_literal_roots(spark):
    paths = ["/a/b/x", "/a/bc/x", "/a/b", "/c", None, "/opt/lib/common/g/run", "/opt/lib/commonX/g", "/a//b/y"]
    df = spark.createDataFrame([(p,) for p in paths], "exe_path string")
    roots = spark.createDataFrame([("/a/b/",), ("/opt/lib/common",)], "root string")
    got = {r["exe_path"]: r["in_library"] for r in library_flag(df, roots).collect()}
    assert got == {"/a/b/x": True, "/a/bc/x": False, "/a/b": True, "/c": False, None: False,
                   "/opt/lib/common/g/run": True, "/opt/lib/commonX/g": False, "/a//b/y": True}


def test_process_events_w4_and_inner_join(spark):
    samples = spark.createDataFrame([
        # pid 1 on GPU 0 and GPU 1 in the same tick: GPU 1 wins, its smallest memory
        (1, "2024-01-01 00:00:00", 0, 1, 300 * 1048576, 10),
        (2, "2024-01-01 00:00:00", 1, 1, 200 * 1048576, 90),
        (3, "2024-01-01 00:00:00", 1, 1, 100 * 1048576, 20),
        # pid 2 is missing from the OS table: dropped
        (4, "2024-01-01 00:00:00", 1, 2, 50 * 1048576, 5),
    ], "id long, timestamp string, gpu_id int, pid long, used_gpu_memory long, gpu_utilization int") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    os_procs = spark.createDataFrame([(1, "Racer.exe", "Racer.exe", None)],
                                     "pid long, name string, command_line string, exe_path string")
    rows = process_events(samples, os_procs, tick_unit="day").collect()
    assert len(rows) == 1
    r = rows[0]
    # GPU 1's utilisation in the tick is its maximum (90) > 60, so the .exe is gaming.
    assert (r["pid"], r["gpu_memory_mb"], r["gpu_utilization"], r["category"]) == (1, 100, 90, "gaming")


def test_process_events_per_host(spark):
    samples = spark.createDataFrame([
        ("a", 1, "2024-01-01 00:00:00", 0, 7, 100 * 1048576, 90),
        ("b", 2, "2024-01-01 00:00:00", 0, 7, 200 * 1048576, 10),
    ], "host string, id long, timestamp string, gpu_id int, pid long, used_gpu_memory long, gpu_utilization int") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    os_procs = spark.createDataFrame([("a", 7, "Game.exe", "Game.exe", None), ("b", 7, "python3", "python3 train.py", None)],
                                     "host string, pid long, name string, command_line string, exe_path string")
    got = {r["host"]: r for r in process_events(samples, os_procs, keys=("host",)).collect()}
    # The same pid and GPU index on two hosts stay apart.
    assert (got["a"]["category"], got["a"]["gpu_memory_mb"]) == ("gaming", 100)
    assert (got["b"]["category"], got["b"]["gpu_memory_mb"]) == ("ml_training", 200)


def test_w4_matches_sampler_insertion_order(spark):
    """Brute force: replay the sampler's inserts (GPU order, memory descending) and keep the last."""
    import random
    from fleetlens.operators.processes import last_inserted_per_pid, per_tick_gpu_pid
    rng = random.Random(11)
    rows = []
    for i in range(2000):
        rows.append((i, rng.randrange(3), rng.randrange(4), rng.randrange(40), rng.choice([None, 0, 5, 5, 9, 100])))
    df = spark.createDataFrame(rows, "id long, tick int, gpu_id int, pid long, used_gpu_memory long")
    want = {}
    for tick in range(3):
        for gpu in range(4):
            procs = [r for r in rows if r[1] == tick and r[2] == gpu]
            procs.sort(key=lambda r: -(r[4] or 0))            # stable sort by memory descending
            for r in procs:
                want[(tick, r[3])] = (gpu, r[4] or 0)
    got = {(r["tick"], r["pid"]): (r["gpu_id"], r["mem"])
           for r in last_inserted_per_pid(per_tick_gpu_pid(df)).collect()}
    assert got == want


def test_a_busy_pid_is_joined_in_slices(spark):
    from pyspark.sql import functions as F
    ticks = spark.range(30_000).select((F.timestamp_seconds(F.col("id") * 2 + 1_700_000_000)).alias("timestamp"), F.lit(0).alias("gpu_id"),
                                       F.lit(50).alias("gpu_utilization"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000 + 100).cast("int").alias("pid"),
                                       F.lit("x").alias("name"), F.lit(1 << 20).cast("long").alias("used_gpu_memory"))
    procs = spark.createDataFrame([(7, "a", "a --x", "/a"), (7, "b", "b", None), (150, None, None, "/c"), (5, "gone", "", "")],
                                  "pid int, name string, command_line string, exe_path string")
    wide = process_events(ticks, procs, tick_unit=None)
    whole = process_events(ticks, procs, tick_unit=None, slices=1)
    assert wide.schema == whole.schema
    assert wide.exceptAll(whole).isEmpty() and whole.exceptAll(wide).isEmpty() and wide.where("pid = 7").count() == 20_000
    # No (pid, slice) group, the unit that one task joins, has more than its share of the busy pid.
    group = F.pmod(F.xxhash64("timestamp"), F.lit(64))
    assert wide.where("pid = 7 AND name = 'a'").groupBy(group).count().agg(F.max("count")).first()[0] < 2 * 10_000 / 64
