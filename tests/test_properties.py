"""Property tests: the Spark expressions against plain-Python statements of the rules."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetlens.functions.classify import (FRAMEWORK_WORDS, INFERENCE_WORDS, PYTHON_ML_KEYWORDS, classify)
from fleetlens.sources.gpu import parse_gpu_csv

WORDS = list(FRAMEWORK_WORDS + PYTHON_ML_KEYWORDS + INFERENCE_WORDS) + [
    "ollama", "python3", "Python", "game", "x.exe", "Racer.EXE", "blender", "serve", "rapid", "-m", "--gen"]


def _case(draw, w):
    return "".join(c.upper() if draw(st.booleans()) else c for c in w)


@st.composite
def process(draw):
    def text():
        n = draw(st.integers(0, 4))
        return " ".join(_case(draw, draw(st.sampled_from(WORDS))) for _ in range(n))
    name = text().replace(" ", "")
    exe = draw(st.one_of(st.none(), st.sampled_from(
        ["/lib/games/a", "/lib/Games/a", "/opt/lib/x/bin", "/opt/lib/x", "/opt/lib/xy/bin", "/usr/bin/a", "/opt//lib/x/a"])))
    return name, text(), exe, draw(st.integers(0, 100))


def _expected(name, cmd, exe, util, roots):
    n, c = name.lower(), cmd.lower()
    if "ollama" in n:
        return "llm_inference"
    if any(w in c for w in FRAMEWORK_WORDS):
        return "ml_training"
    if "python" in n and any(w in c for w in PYTHON_ML_KEYWORDS):
        return "llm_inference" if any(w in c for w in INFERENCE_WORDS) else "ml_training"
    if exe is not None:
        parts = [p for p in exe.split("/") if p]
        for r in roots:
            rp = [p for p in r.split("/") if p]
            if parts[:len(rp)] == rp:
                return "gaming"
        if "game" in exe.lower():
            return "gaming"
    if n.endswith(".exe") and util > 60:
        return "gaming"
    return "general_compute"


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(process(), min_size=300, max_size=300))
def test_classification_matches_rules(spark, procs):
    roots = ["/opt/lib/x"]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(procs)],
                               "i int, name string, command_line string, exe_path string, gpu_utilization int")
    got = {r["i"]: r["category"] for r in classify(df, roots).collect()}
    for i, p in enumerate(procs):
        assert got[i] == _expected(*p, roots), p


@st.composite
def probe_line(draw):
    def num():
        return draw(st.sampled_from(["0", "7", "+7", "-3", "12.5", "", "x", "4294967296", "2147483647", " 9 "]))
    def flt():
        return draw(st.sampled_from(["250.5", "0", "-4.5", "1e3", "[N/A]", "nan", "inf", ".5", "5.", "1.5d"]))
    fields = [num(), draw(st.sampled_from(["A", " B ", ""])), num(), num(), num(), num(), num(), flt()]
    fields = fields[:draw(st.integers(6, 8))] + draw(st.sampled_from([[], ["extra"]]))
    return ",".join(fields)


def _u(s, limit=2147483647):
    s = s.strip()
    body = s[1:] if s.startswith("+") else s
    if not body.isdigit():
        return None
    v = int(body)
    return v if v <= limit else None


def _f(s):
    s = s.strip()
    import re
    if not (re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", s)
            or re.fullmatch(r"[+-]?(?i:inf|infinity|nan)", s)):
        return None
    v = float(s)
    if math.isnan(v) or v <= 0:
        return 0
    return min(math.floor(v), 2147483647)


def _expected_row(line):
    parts = [p.strip() for p in line.split(",")]
    if len(parts) < 8:
        return None
    vals = [_u(parts[0]), _u(parts[2]), _u(parts[3]), _u(parts[4], 2 ** 63 // 1048576), _u(parts[5], 2 ** 63 // 1048576),
            _u(parts[6]), _f(parts[7])]
    if any(v is None for v in vals):
        return None
    return (vals[0], parts[1], vals[1], vals[2], vals[3] * 1048576, vals[4] * 1048576, vals[5], vals[6])


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(probe_line(), min_size=300, max_size=300))
def test_probe_parse_matches_rules(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    got = {r["i"]: (r["gpu_id"], r["name"], r["utilization_gpu"], r["utilization_memory"], r["memory_used"],
                    r["memory_total"], r["temperature"], r["power_usage"]) for r in parse_gpu_csv(df).collect()}
    for i, line in enumerate(lines):
        assert got.get(i) == _expected_row(line), line


# ---------------------------------------------------------------- chunk records
import json  # noqa: E402

from fleetlens.sources.chunks import chunk_record  # noqa: E402

VALUES = ['"llama2"', '"2024-01-01T00:00:00Z"', '"Hi"', '""', "true", "false", "null", "0", "7", "-1", "1.0",
          "1e3", "9223372036854775807", "9223372036854775808", "[]", "{}", '{"a":1}']
FIELDS = ["model", "created_at", "response", "done", "eval_count", "eval_duration", "prompt_eval_count",
          "prompt_eval_duration", "extra"]


@st.composite
def record_line(draw):
    keys = draw(st.lists(st.sampled_from(FIELDS), min_size=0, max_size=7))
    # Mostly well-typed required fields, so valid records are common.
    base = {"model": '"m"', "created_at": '"t"', "done": "false"} if draw(st.booleans()) else {}
    items = [(k, v) for k, v in base.items()] + [(k, draw(st.sampled_from(VALUES))) for k in keys]
    body = "{" + ",".join(f'"{k}":{v}' for k, v in items) + "}"
    tail = draw(st.sampled_from(["", "", " ", " x", ",", "}"]))
    return draw(st.sampled_from(["", " ", "\t"])) + body + tail


def _strict_record(line):
    s = line.strip()
    if not s:
        return None

    def pairs(ps):
        keys = [k for k, _ in ps]
        if len(keys) != len(set(keys)):
            raise ValueError("duplicate key")
        return dict(ps)
    try:
        obj = json.loads(s, object_pairs_hook=pairs)
    except ValueError:
        return None
    if not isinstance(obj, dict):
        return None
    if not isinstance(obj.get("model"), str) or not isinstance(obj.get("created_at"), str):
        return None
    if not isinstance(obj.get("done"), bool):
        return None
    if obj.get("response") is not None and not isinstance(obj["response"], str):
        return None
    counts = {}
    for k in ("eval_count", "eval_duration", "prompt_eval_count", "prompt_eval_duration"):
        v = obj.get(k)
        if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 0 or v > 2 ** 63 - 1):
            return None
        counts[k] = v
    return (obj["model"], obj["created_at"], obj.get("response"), obj["done"], counts["eval_count"],
            counts["eval_duration"], counts["prompt_eval_count"], counts["prompt_eval_duration"])


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(record_line(), min_size=400, max_size=400))
def test_chunk_record_matches_strict_json(spark, lines):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(list(enumerate(lines)), "i int, l string")
    got = {r["i"]: (tuple(r["r"]) if r["r"] is not None else None)
           for r in df.select("i", chunk_record(F.col("l")).alias("r")).collect()}
    for i, line in enumerate(lines):
        assert got[i] == _strict_record(line), line
