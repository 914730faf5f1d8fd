"""Secret scans with multipart credential linking.

Each text is cut into parts: strong ones (assignments of secrets, access identifiers,
long hexadecimal strings) and weak ones (account names, opaque strings, short
hexadecimal strings, endpoints).  Strong parts are always reported.  A weak part is
reported only if, within ``reach`` characters and inside one scope (lines without an
empty line between them), an identifier and a secret stand together, the part itself
counting for its own role.  Parts meet in an interval semi join on document, scope and
bin, which stops at the first partner and never lists pairs.

Defined results: null and empty texts have no parts and an empty span list; offsets are
code points, ends exclusive; texts are scanned whole; repeated rows, also of one doc_id,
are scanned each on their own; an empty table gives an empty result; further columns pass
through, the columns that are added replace those of the same name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from segspark.llm._scratch import materialize

#: Distance in code points within which parts belong together.
REACH = 300
#: Kinds in the order of spans with equal starts, and the role of each.
KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "opaque": "secret", "endpoint": "endpoint"}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: those of [0-9a-f]+ with 24 or more characters
ACCOUNT = re.compile(r"""\b(?:access_?key_?id|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*\d)(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}|(?<![0-9A-Za-z])[0-9a-f]{16,23}(?![0-9A-Za-z])")
# A run of host characters is tried once, from its beginning, and never given back.
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?\b|(?<![A-Za-z0-9_.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++:\d{2,5}\b""", re.A)
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def strong_parts(text: str) -> list[tuple[str, int, int]]:
    """The base spans: leftmost, not overlapping within a kind, failing matches dropped."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def weak_parts(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak candidates that overlap no strong part and no weak one found before them."""
    accounts = [("account", *m.span()) for m in ACCOUNT.finditer(text)] if "=" in text or ":" in text else []
    if not accounts and not any(k == "access" for k, _, _ in strong):
        return []  # without an identifier nothing weak can be reported
    found = accounts + [("opaque", *m.span()) for m in OPAQUE.finditer(text)] + [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    taken, out = disjoint((s, e) for _, s, e in strong), []
    for kind in ("account", "opaque", "endpoint"):
        begins = [s for s, _ in taken]
        free = [x for x in found if x[0] == kind and (not (at := bisect_left(begins, x[2])) or taken[at - 1][1] <= x[1])]
        out += free
        taken = sorted(taken + [(s, e) for _, s, e in free])
    return out


def disjoint(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that the spans cover, in order; spans that overlap become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("scope", LongType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())]))


def parts(docs: DataFrame, text: str = "text", keep_text: bool = False, only_weak: bool = False) -> DataFrame:
    """``docs``, its text only if asked for, with a row number ``_row`` and the arrays
    ``strong`` and ``weak``; ``only_weak``: without the rows that have no weak parts."""
    own = [f for f in docs.schema.fields if f.name not in ("_row", "strong", "weak") and (keep_text or f.name != text)]
    schema = StructType([*own, StructField("_row", LongType()), StructField("strong", ArrayType(SPAN)), StructField("weak", ArrayType(SPAN))])

    def scoped(spans: list[tuple[str, int, int]], ends: list[int]) -> list[dict]:
        return [{"kind": k, "start": s, "end": e, "scope": bisect_right(ends, s)} for k, s, e in spans]

    at = next((i for i, f in enumerate(own) if f.name == text), len(own))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            strong, weak = [], []
            some = []
            for i, x in enumerate(batch.column(at)):
                body = x.as_py() or ""
                a = strong_parts(body)
                b = weak_parts(body, a)
                if only_weak and not b:
                    continue
                some.append(i)
                ends = [m.start() for m in BLANK.finditer(body)] if b else []
                strong.append(scoped(a, ends))
                weak.append(scoped(b, ends))
            rows = pa.array(range(row, row + len(strong)), pa.int64())
            row += len(strong)
            batch = batch.take(pa.array(some, pa.int64())) if only_weak else batch
            columns = [*batch.columns[: len(own)], rows, pa.array(strong, _ARROW), pa.array(weak, _ARROW)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    body = [] if keep_text else [F.col(f"`{text}`").alias("_body")]
    return docs.select(*(F.col(f"`{f.name}`") for f in own), *body).mapInArrow(cut, schema)


def link_parts(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts (``_row, kind, start, end``) with an identifier and a secret in reach."""
    role = F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), F.col("p.kind"))
    each = lambda column: found.filter(F.size("weak") > 0).select("_row", F.explode(column).alias("p")).select("_row", "p.*", role.alias("role"))
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach)))
    partner = each(F.concat("strong", "weak")).withColumn("bin", bins(F.col("start") - reach, F.col("end") + reach))
    linked = each("weak").withColumn("bin", bins(F.col("start"), F.col("end")))
    for need in ("identifier", "secret"):
        near = partner.filter(F.col("role") == need).alias("b")
        a = linked.alias("a")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("_row", "scope", "bin")]
        within = (F.col("b.start") <= F.col("a.end") + reach) & (F.col("b.end") >= F.col("a.start") - reach)
        met = a.join(near, [*same, within], "left_semi")
        linked = met.filter(F.col("role") != need).unionByName(linked.filter(F.col("role") == need))
    return linked.select("_row", "kind", "start", "end").distinct()


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` without its text, with ``strong`` (base spans), ``linked`` (weak spans that
    are reported), and both as the strings ``base_spans`` and ``spans``."""
    found = materialize(parts(docs, text), "parts")
    span = F.struct("kind", "start", "end")
    linked = link_parts(found, reach).groupBy("_row").agg(F.collect_list(span).alias("linked"))
    strong = F.transform("strong", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    both = found.join(linked, "_row", "left").withColumn("strong", strong)
    both = both.withColumn("linked", F.coalesce(F.col("linked"), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    return both.withColumn("base_spans", _listed(F.col("strong"))).withColumn("spans", _listed(F.concat("strong", "linked"))).drop("_row", "weak")


MARK = "[SECRET]"


def redact(text: str, spans: Iterable[tuple[int, int]], mark: str = MARK) -> str:
    """``text`` with a mark in place of every stretch that spans cover; stretches that
    touch each other have one mark each."""
    out, at = [], 0
    for start, end in disjoint(spans):
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with the reported spans of each text redacted, columns unchanged.

    Documents without weak candidates, nearly all, are redacted where they are read; only
    the others are written to the shared folder and meet the linked spans."""
    at, names = docs.columns.index(text), [f"c{i}" for i in range(len(docs.columns))]
    docs_names = docs.columns

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, new = [], []
            for i, x in enumerate(batch.column(at)):
                body = x.as_py()
                strong = strong_parts(body or "")
                if not weak_parts(body or "", strong):
                    some.append(i)
                    new.append(redact(body, ((s, e) for _, s, e in strong)) if strong else body)
            columns = list(batch.take(pa.array(some, pa.int64())).columns)
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, places = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = [redact(b, [(x["start"], x["end"]) for x in p]) if p else b for b, p in zip(bodies, places, strict=True)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    found = materialize(parts(docs.toDF(*names), names[at], keep_text=True, only_weak=True), "parts")
    linked = link_parts(found, reach).groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    both = found.join(linked, "_row", "left").withColumn("linked", F.coalesce("linked", none))
    place = lambda column: F.transform(column, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    spans = F.concat(place("strong"), place("linked"))
    late = both.select(*names, spans.alias("spans")).mapInArrow(clean, docs.schema)
    return docs.mapInArrow(sure, docs.schema).unionByName(late)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = lambda kind: F.size(F.filter("strong", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan(docs).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2("base_spans", 256).alias("base_sha256"), "spans")
