"""Secrets in texts: strong patterns, and weak parts that count only where they complement each other."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.llm.text import bounded_batches, slices, whole_text
from reviewlens.storage import scratch_path

# Strong patterns, each reported wherever it stands.
ASSIGN = re.compile(
    r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

# Weak patterns, by the part they play. The value is group 1.
IDENTIFIER = re.compile(
    r"(?ai:\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?|key_?id))"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})"
)
ENDPOINT = re.compile(
    r"((?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}"
    r"|(?ai:\b(?:host(?:name)?|endpoint|server))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,})"
)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/_=-])")
SCOPE_BREAK = re.compile(r"\n[\x20\t\r]*\n")

# The order in which kinds at one start are listed; the first three are strong.
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
# How many bits a character of a token must carry to pass for a secret.
MIN_ENTROPY = 3.5

_PART = "struct<kind:string,start:long,stop:long,scope:int>"


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _is_token(token: str) -> bool:
    """Letters of both cases and digits, without much regularity."""
    return (
        any(c.isdigit() for c in token)
        and any(c.islower() for c in token)
        and any(c.isupper() for c in token)
        and _entropy(token) >= MIN_ENTROPY
    )


def parts_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the strong and weak parts of a text, in code points."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    strong = sorted((start, stop) for _, start, stop in found)
    starts = [start for start, _ in strong]
    reached = list(accumulate((stop for _, stop in strong), max))
    weak = [("identifier", *m.span(1)) for m in IDENTIFIER.finditer(text)]
    weak += [("endpoint", *m.span(1)) for m in ENDPOINT.finditer(text)]
    weak += [("secret", *m.span(1)) for m in TOKEN.finditer(text) if _is_token(m[1])]
    for part in weak:
        before = bisect_left(starts, part[2])  # strong spans that begin before this one ends
        if not before or reached[before - 1] <= part[1]:
            found.append(part)
    return sorted(found, key=lambda p: (p[1], KINDS.index(p[0]), p[2]))


def scan_parts(docs: DataFrame) -> DataFrame:
    """(doc_id, content, parts) of every row; ``content`` is a hash of the text."""
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("scope", pa.int32())])
        )
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column(2).to_pylist():
                found = parts_of(text)
                breaks = [m.end() for m in SCOPE_BREAK.finditer(text)] if found else []
                rows.append(
                    [
                        {"kind": k, "start": a, "stop": b, "scope": bisect_right(breaks, a)}
                        for k, a, b in found
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, kind)],
                names=["doc_id", "content", "parts"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(whole_text()).alias("content"),
        whole_text().alias("text"),
    )
    return rows.mapInArrow(scan, f"doc_id long, content long, parts array<{_PART}>")


def link_parts(parts: DataFrame, reach: int | None = None) -> DataFrame:
    """The weak parts that have a complement in the same scope, within ``reach`` code points if given.

    Identifiers and endpoints need a secret (weak or strong), weak secrets an identifier, an access
    key or an endpoint. An interval join by nearest neighbour: within a document's scope, in order of
    position, the closest complement before and behind a part decides, so the work is a sort and
    no pair is ever formed.
    """
    rows = parts.select(
        F.col("doc_id").alias("d"), F.col("content").alias("c"), F.explode("parts").alias("part")
    ).select("d", "c", "part.*").distinct()
    secret = F.col("kind").isin("assign", "hex", "secret")
    partner = F.col("kind").isin("access", "identifier", "endpoint")
    scope = Window.partitionBy("d", "c", "scope")
    back = scope.orderBy("start", "stop", "kind").rowsBetween(Window.unboundedPreceding, -1)
    ahead = scope.orderBy(F.desc("start"), F.desc("stop"), F.desc("kind")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    near = rows
    for name, kind in (("secret", secret), ("partner", partner)):
        near = near.withColumns(
            {
                f"{name}_before": F.max(F.when(kind, F.col("stop"))).over(back),
                f"{name}_behind": F.min(F.when(kind, F.col("start"))).over(ahead),
            }
        )

    def close(name: str):
        if reach is None:
            return F.coalesce(f"{name}_before", f"{name}_behind").isNotNull()
        before = F.col("start") - F.col(f"{name}_before") <= reach
        behind = F.col(f"{name}_behind") - F.col("stop") <= reach
        return F.coalesce(before, F.lit(False)) | F.coalesce(behind, F.lit(False))

    linked = ((F.col("kind") == "secret") & close("partner")) | (
        F.col("kind").isin("identifier", "endpoint") & close("secret")
    )
    return near.where(linked).select("d", "c", "kind", "start", "stop", "scope")


def find_secrets(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """Strong secrets and linked weak parts of whole texts.

    ``docs``: doc_id, text. Result, one row per row: doc_id, base and spans, arrays of (kind, start,
    stop) in code points, ordered by start, then kind, then stop. ``base`` has assignments of
    passwords and the like, access keys and long hexadecimal strings; ``spans`` adds identifiers,
    random-looking tokens of any length and endpoints that do not touch a base span, where complementary
    parts stand in the same scope (a block of text between empty lines), however far apart, or within
    ``reach`` code points of each other if that is given.

    Null and empty texts have no spans. Repeated rows give repeated results; ids may be null or come
    with several texts, as texts are told apart by a hash. Other columns are ignored; no documents, no
    rows. Texts are scanned whole, one at a time; the parts found are stored in the shared folder.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "secret-parts")
    scan_parts(docs).write.parquet(path)
    parts = spark.read.parquet(path)
    some = parts.where(F.exists("parts", lambda p: p["kind"].isin(*KINDS[3:])))
    linked = link_parts(some, reach).groupBy("d", "c").agg(
        F.collect_list(F.struct("kind", "start", "stop", "scope")).alias("linked")
    )
    base = F.filter("parts", lambda p: p["kind"].isin(*KINDS[:3]))
    joined = parts.join(
        linked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")), "left"
    )
    return joined.select(
        "doc_id",
        _ordered(base).alias("base"),
        _ordered(F.concat(base, F.coalesce("linked", F.array().cast(f"array<{_PART}>")))).alias("spans"),
    )


def _ordered(parts):
    """Parts by start, then kind as listed, then stop."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(
        parts,
        lambda p: F.struct(
            p["start"].alias("start"),
            F.array_position(kinds, p["kind"]).alias("rank"),
            p["stop"].alias("stop"),
            p["kind"].alias("kind"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["stop"].alias("stop")),
    )


def spans_text(spans: str):
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"], p["stop"])), ","
    )
