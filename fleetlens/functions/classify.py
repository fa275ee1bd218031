"""Workload classification of GPU processes (P1 family), as one CASE expression.

Rules, first that holds wins:

1. the process name contains ``ollama``                     -> llm_inference
2. the command line names an ML framework                   -> ml_training
3. a python process whose command line names an ML keyword  -> llm_inference
   when the command line also looks like inference, else       ml_training
4. the executable lies under a game library root, or its path
   contains ``game``, or the name ends in ``.exe`` while GPU
   utilisation is above 60                                   -> gaming
5. otherwise                                                 -> general_compute

All matching is case-insensitive substring matching on the lower-cased text
(literal ``contains``, not regex: ``model.py`` holds a literal dot).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (must equal the reference's rule lists).
FRAMEWORK_WORDS = ("tensorflow", "torch", "jax", "mxnet")
PYTHON_ML_KEYWORDS = ("transformers", "torch", "tensorflow", "keras", "pytorch", "jax", "flax",
                      "diffusers", "vllm", "llama", "huggingface", "model.py", "train.py")
INFERENCE_WORDS = ("generate", "inference", "predict", "serve", "api")
GAME_UTILIZATION_THRESHOLD = 60
LLM_INFERENCE = "llm_inference"
ML_TRAINING = "ml_training"
GAMING = "gaming"
GENERAL_COMPUTE = "general_compute"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any_contains(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _strip_trailing_slash(root: str) -> str:
    return root if root == "/" else root.rstrip("/")


def normalise_path(path) -> Column:
    """Collapse repeated separators and drop a trailing one, as path components compare."""
    p = F.regexp_replace(_col(path), "/{2,}", "/")
    return F.when(p.rlike("^/$"), p).otherwise(F.regexp_replace(p, "/$", ""))


def under_any_root(path, roots: Sequence[str]) -> Column:
    """Path-component prefix test (P1f): ``/a/b`` covers ``/a/b`` and ``/a/b/x``, not ``/a/bc``."""
    p = normalise_path(path)
    roots = [_strip_trailing_slash(r) for r in roots]
    if not roots:
        return F.lit(False)
    tests = []
    for r in roots:
        prefix = r if r.endswith("/") else r + "/"
        tests.append((p == F.lit(r)) | p.startswith(prefix))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def is_framework(cmdline) -> Column:
    """The command line names an ML framework."""
    return _any_contains(F.lower(F.coalesce(_col(cmdline), F.lit(""))), FRAMEWORK_WORDS)


def is_python_ml(name, cmdline) -> Column:
    """Python process with an ML keyword in its command line."""
    n = F.lower(F.coalesce(_col(name), F.lit("")))
    c = F.lower(F.coalesce(_col(cmdline), F.lit("")))
    return n.contains("python") & _any_contains(c, PYTHON_ML_KEYWORDS)


def looks_like_inference(cmdline) -> Column:
    """P1d: inference words anywhere in the command line (``api`` also inside other words)."""
    return _any_contains(F.lower(F.coalesce(_col(cmdline), F.lit(""))), INFERENCE_WORDS)


def is_game(name, exe_path, gpu_util, library_roots: Sequence[str] = (),
            in_library: Column | None = None) -> Column:
    """P1e: library path, ``game`` in the path, or ``*.exe`` at utilisation above 60.

    ``in_library`` may be given instead of ``library_roots`` when the library
    membership was computed by a join (see operators.processes.library_flag).
    """
    exe = _col(exe_path)
    lib = in_library if in_library is not None else under_any_root(exe, library_roots)
    by_path = exe.isNotNull() & (F.coalesce(lib, F.lit(False)) | F.lower(exe).contains("game"))
    # Every name pattern of the rule list implies "ends in .exe" (case-insensitive);
    # endswith rather than a regex anchor, which in Java also matches before a final newline.
    by_name = F.lower(F.coalesce(_col(name), F.lit(""))).endswith(".exe") & (
        F.coalesce(_col(gpu_util), F.lit(0)) > GAME_UTILIZATION_THRESHOLD)
    return by_path | by_name


def workload_category(name, cmdline, exe_path, gpu_util, library_roots: Sequence[str] = (),
                      in_library: Column | None = None) -> Column:
    """The workload category of one process, as a native CASE expression."""
    n = F.lower(F.coalesce(_col(name), F.lit("")))
    return (
        F.when(n.contains("ollama"), F.lit(LLM_INFERENCE))
        .when(is_framework(cmdline), F.lit(ML_TRAINING))
        .when(is_python_ml(name, cmdline),
              F.when(looks_like_inference(cmdline), F.lit(LLM_INFERENCE)).otherwise(F.lit(ML_TRAINING)))
        .when(is_game(name, exe_path, gpu_util, library_roots, in_library), F.lit(GAMING))
        .otherwise(F.lit(GENERAL_COMPUTE))
    )


def classify(df: DataFrame, library_roots: Sequence[str] = (), name: str = "name",
             command_line: str = "command_line", exe_path: str = "exe_path",
             gpu_utilization: str = "gpu_utilization", out: str = "category") -> DataFrame:
    """Add the ``category`` column to a frame of processes."""
    return df.withColumn(out, workload_category(name, command_line, exe_path, gpu_utilization,
                                                library_roots))
