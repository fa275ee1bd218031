"""LLM traffic sources: streamed response chunks (S4), request model (S5),
request log filter (S6), log lines (S7), running-model snapshots (S8).

JSON is parsed strictly, the way a typed deserializer would: exact types, no
duplicate keys, no trailing text, no negative or fractional counts.  Spark's
``from_json`` is lenient on all of these, so records are parsed to VARIANT and
each field's type is checked.  A line ``L`` is parsed as ``[L,"mark"]``: the
marker survives only if ``L`` is one complete JSON value, which rejects
trailing text.  The marker is a hash of the line, so a line cannot contain its
own.  Everything is an expression; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.sources.gpu import unicode_trim

MAX_REQUEST_BODY = 10 * 1024 * 1024
# The two streaming endpoints.
STREAMING_PATHS = ("/api/generate", "/api/chat")

CHUNK_RECORD = ("struct<model:string,created_at:string,response:string,done:boolean,"
                "eval_count:decimal(20,0),eval_duration:decimal(20,0),prompt_eval_count:decimal(20,0),"
                "prompt_eval_duration:decimal(20,0)>")
COUNTS = ("eval_count", "eval_duration", "prompt_eval_count", "prompt_eval_duration")
U64_MAX = 18446744073709551615


def json_wrapped(text: Column) -> Column:
    """The VARIANT of ``[text,"mark"]`` (null when not JSON) with its mark; see ``unwrap``.  A text without
    ``]`` cannot close the array, so only others need the hash."""
    mark = F.when(F.contains(text, F.lit("]")), F.sha2(text, 256)).otherwise(F.lit(""))
    wrap = lambda m: F.struct(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), m, F.lit('"]'))).alias("v"), m.alias("mark"))
    return F.get(F.transform(F.array(mark), wrap), 0)


def unwrap(wrapped: Column) -> Column:
    """The value of a ``json_wrapped`` text when the text was exactly one JSON value, else null."""
    v = wrapped["v"]
    ok = (F.try_variant_get(v, "$[1]", "string") == wrapped["mark"]) & F.variant_get(v, "$[2]", "variant").isNull()
    return F.when(ok, F.variant_get(v, "$[0]", "variant"))


def json_value(text: Column) -> Column:
    """VARIANT of text that is exactly one JSON value, else null."""
    return unwrap(json_wrapped(text))


def _type(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def _typed_fields(v: Column) -> Column:
    """The fields of an object as one struct of (value, type); null when ``v`` is not an object.  One
    extraction takes all fields, and every type is asked for once."""
    names = ["model", "created_at", "done", "response", *COUNTS]
    fields = F.try_variant_get(v, "$", "struct<" + ",".join(f"{n}:variant" for n in names) + ">")
    typed = lambda f: F.struct(*[F.struct(f[n].alias("v"), F.schema_of_variant(f[n]).alias("t")).alias(n) for n in names])
    return F.get(F.transform(F.array(fields), lambda f: F.when(f.isNotNull(), typed(f))), 0)


def _count(f: Column) -> Column:
    """A count as DECIMAL: null when absent or null, -1 when it is no unsigned 64-bit JSON integer.  Above
    BIGINT, VARIANT holds whole numbers as decimals."""
    whole = (f["t"] == "BIGINT") | f["t"].isin("DECIMAL(19,0)", "DECIMAL(20,0)")
    return F.when(f["t"].isNull() | (f["t"] == "VOID"), F.lit(None)).when(whole, F.try_variant_get(f["v"], "$", "decimal(38,0)")) \
        .otherwise(F.lit(-1).cast("decimal(38,0)"))


def record_of_fields(f: Column) -> Column:
    """S4 record of ``_typed_fields``: a struct (CHUNK_RECORD) or null when it
    is not a valid chunk (``model``, ``created_at`` strings and ``done`` boolean
    required; ``response`` optional string; counts optional unsigned)."""
    required = (f["model"]["t"] == "STRING") & (f["created_at"]["t"] == "STRING") & (f["done"]["t"] == "BOOLEAN")
    response = f["response"]["t"]
    ok = required & (response.isNull() | response.isin("VOID", "STRING"))
    text = lambda name: F.try_variant_get(f[name]["v"], "$", "string")

    def record(counts: Column) -> Column:
        fits = F.forall(counts, lambda c: F.coalesce(c.between(F.lit(0), F.lit(str(U64_MAX)).cast("decimal(20,0)")), F.lit(True)))
        return F.when(fits, F.struct(
            text("model").alias("model"), text("created_at").alias("created_at"), text("response").alias("response"),
            F.try_variant_get(f["done"]["v"], "$", "boolean").alias("done"),
            *[F.get(counts, i).cast("decimal(20,0)").alias(n) for i, n in enumerate(COUNTS)]))

    checked = F.get(F.transform(F.array(F.array(*[_count(f[n]) for n in COUNTS])), record), 0)
    return F.when(F.coalesce(ok, F.lit(False)), checked)


def chunk_record(line: Column) -> Column:
    """S4 record of one line of text (see ``record_of_fields``)."""
    return F.get(_records(F.array(line), keep_invalid=True), 0)


def _records(lines: Column, keep_invalid: bool = False) -> Column:
    """Valid records of an array of lines, in line order.  Each line is parsed once, its fields are taken
    once, then checked: one array per step, as a lambda computes an expression anew wherever it stands."""
    fields = F.transform(F.transform(lines, json_wrapped), lambda w: _typed_fields(unwrap(w)))
    records = F.transform(fields, record_of_fields)
    return records if keep_invalid else F.filter(records, lambda r: r.isNotNull())


def _lines(text: Column) -> Column:
    """Lines of a text: split on LF, a trailing CR dropped, trimmed, empties removed."""
    return F.filter(F.transform(F.split(text, "\n"), lambda s: unicode_trim(s)), lambda s: F.length(s) > 0)


def parse_llm_chunks(raw: DataFrame, chunk: str = "chunk", all_lines: bool = False) -> DataFrame:
    """Raw chunk bytes to chunk records.

    The bytes must be UTF-8.  With ``all_lines=False`` (faithful) the first line
    that parses wins and the rest of the chunk is ignored; chunks without such
    a line are dropped.  ``all_lines=True`` keeps every valid line, numbered by
    ``line_no`` within the chunk.  The work is per row (higher-order functions
    over the chunk's lines): no explode, no shuffle in the faithful mode.
    """
    c = F.col(chunk)
    text = c.cast("string") if dict(raw.dtypes)[chunk] == "binary" else c
    valid = F.is_valid_utf8(text) if dict(raw.dtypes)[chunk] == "binary" else F.lit(True)
    records = _records(_lines(text))
    carried = [x for x in raw.columns if x != chunk]
    base = raw.select(*carried, F.when(valid, records).alias("_recs"))
    if all_lines:
        out = base.select(*carried, F.posexplode("_recs").alias("line_no", "_r"))
        return out.select(*carried, "line_no", "_r.*")
    return base.select(*carried, F.get(F.col("_recs"), 0).alias("_r")).where(F.col("_r").isNotNull()) \
        .select(*carried, "_r.*")


def request_model(body) -> Column:
    """The request's ``model``: a JSON string value, else ``unknown`` (empty
    body, invalid JSON, absent, null or non-string model).  An empty string stays."""
    b = F.col(body) if isinstance(body, str) else body
    text = b.cast("string")
    v = json_value(text)
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    is_str = F.coalesce(_type(v, "$.model") == "STRING", F.lit(False))
    # Bytes that are not UTF-8 are not JSON (a cast would substitute U+FFFD instead).
    utf8 = F.coalesce(F.is_valid_utf8(text), F.lit(False))
    return F.when(utf8 & is_obj & is_str, F.variant_get(v, "$.model", "string")).otherwise(F.lit("unknown"))


def stored_counts(chunks: DataFrame) -> DataFrame:
    """Chunk counts as the BIGINT columns of the stored chunks: a count above BIGINT becomes its largest value."""
    most = F.lit(9223372036854775807).cast("decimal(20,0)")
    return chunks.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.col(c), most)).cast("long")
                               for c in COUNTS if c in chunks.columns})


def llm_requests(log: DataFrame, max_body: int | None = MAX_REQUEST_BODY) -> DataFrame:
    """Requests that open a session: streaming endpoint, 2xx status, body
    of at most ``max_body`` bytes (the proxy's own admission rule; None admits all).
    The session id is a hash of the request key, so a retried
    job assigns the same ids."""
    keep = F.col("path").isin(*STREAMING_PATHS) & F.col("status").between(200, 299)
    if max_body is not None:
        keep = keep & (F.coalesce(F.octet_length(F.col("body")), F.lit(0)) <= max_body)
    return log.where(keep).select(
        F.sha2(F.col("request_key").cast("string"), 256).alias("session_id"),
        "request_key", "ts", "path", request_model("body").alias("model"))


def parse_llm_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines naming ``generate`` or ``chat`` (case-sensitive) that are a
    valid chunk record; others dropped."""
    line = F.col(value)
    carried = [x for x in lines.columns if x != value]
    return (lines.where(line.contains("generate") | line.contains("chat"))
            .select(*carried, F.get(_records(F.array(line)), 0).alias("_r")).where(F.col("_r").isNotNull())
            .select(*carried, "_r.*"))


def running_models(snapshots: DataFrame, body: str = "body") -> DataFrame:
    """Names of running models per snapshot ``{"models":[{"name":...}]}``;
    a non-2xx or malformed response lists none."""
    v = json_value(F.col(body).cast("string"))
    models = F.variant_get(v, "$.models", "variant")
    is_arr = F.coalesce(F.schema_of_variant(models).startswith("ARRAY"), F.lit(False))
    names = F.try_variant_get(models, "$", "array<variant>")   # null, not an error, for a non-array
    all_ok = F.forall(names, lambda m: F.coalesce(_type(m, "$.name") == "STRING", F.lit(False)))
    good = F.col("status").between(200, 299) & is_arr & F.coalesce(all_ok, F.lit(False))
    carried = [x for x in snapshots.columns if x != body]
    return (snapshots.where(good)
            .select(*carried, F.posexplode(F.transform(names, lambda m: F.variant_get(m, "$.name", "string")))
                    .alias("position", "model")))
