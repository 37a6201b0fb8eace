"""Secret scans over an incremental blob ledger.

Each version of a path is addressed by the SHA-256 of its content. The ledger is a
Parquet table of findings by (blob, rule version), a folder for each run; a run
scans only the distinct blobs that have no row for the current rules, adds
theirs, and joins the findings back to every path that holds the blob. Running
again over the same versions scans nothing. Runs may overlap or be repeated: a blob counts
once however often it was entered. The rule version follows from the patterns.

Defined cases: null text is the empty blob; texts of any length are scanned whole; repeated rows each get the blob's
findings; null ids are kept; an empty table gives no rows; columns other than `paths` are
ignored. Positions are code points, ends exclusive; spans that start at one place come in the order of `KINDS`.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import filesystem, fresh_path

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones may be skipped
_KEY_WORDS = ("passw", "secret", "token", "api")
#: Kinds that the method adds to the base ones: name, literal that must occur, pattern.
_ADDED = (
    ("private_key", "PRIVATE KEY", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")),
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("forge_token", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{30,}")),
    ("url_login", "://", re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:[^\s/:@]{3,}@[A-Za-z0-9.-]+")),
)
KINDS = ("assign", "access", "hex", *(k for k, _, _ in _ADDED))
#: Any change to kinds or patterns gives another number: earlier blobs are then scanned anew.
RULES_VERSION = zlib.crc32(repr([KINDS, _ASSIGN.pattern, _ACCESS.pattern, _HEX.pattern, _KEY_WORDS, 12, 18, *((w, p.pattern) for _, w, p in _ADDED)]).encode()) >> 1


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in _KEY_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for k, (_, literal, pattern) in enumerate(_ADDED, 3):
        if literal in text:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in batch.column("text"):
            spans = find_spans(text.as_py() or "")
            kinds = [k for _, k, _ in spans]
            for c, k in (("n_assign", 0), ("n_access", 1), ("n_hex", 2)):
                out[c].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(_joined([s for s in spans if s[1] < 3]).encode()).hexdigest())
            out["spans"].append(_joined(spans))
        counts = {c: pa.array(out[c], pa.int64()) for c in ("n_assign", "n_access", "n_hex")}
        yield pa.RecordBatch.from_pydict(
            {"blob": batch.column("blob"), "rules": pa.array([RULES_VERSION] * batch.num_rows, pa.int32()), **counts, "base_sha256": out["base_sha256"], "spans": out["spans"]}
        )


_LEDGER = "blob binary, rules int, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(versions: DataFrame, ledger: str | None = None, paths: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings of every version: its `paths` columns, n_assign, n_access, n_hex, base_sha256, spans.

    `ledger` is the table's folder in shared storage; without one a new ledger is begun.
    """
    spark = versions.sparkSession
    folder = ledger or fresh_path(spark, "ledger")
    content = F.coalesce("text", F.lit(""))
    addressed = versions.select(F.struct(*paths).alias("path"), F.unhex(F.sha2(content, 256)).alias("blob"), content.alias("text"))
    blobs = addressed.groupBy("blob").agg(F.first("text").alias("text"))

    def entries() -> DataFrame:
        found = spark.read.schema(_LEDGER).option("recursiveFileLookup", "true").parquet(folder)
        return found.filter(F.col("rules") == RULES_VERSION).drop("rules")

    store, at = filesystem(folder)
    if store.get_file_info(at).type != fs.FileType.NotFound:
        blobs = blobs.join(entries().select("blob"), "blob", "left_anti")
    blobs.mapInArrow(_scan, _LEDGER).write.parquet(f"{folder}/run-{uuid.uuid4().hex}")
    # A blob's entries under one rule version are equal: any of them will do.
    findings = entries().groupBy("blob").agg(*[F.max(c).alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])
    return addressed.select("path", "blob").join(findings, "blob").select("path.*", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
