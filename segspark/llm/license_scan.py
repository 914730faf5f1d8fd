"""License scans by ordered signature rules.

A text becomes lower-case words joined by single blanks.  One Aho-Corasick pass finds
which gate keywords it holds; only the rules of those keywords run their regular
expressions: the signatures written by hand in ``_signatures``, and the forms in which
names of licenses are met.  Every detection is an interval of words with a priority; one
that lies inside the interval of a detection of better priority, or of a longer one of its
own priority, is suppressed.  Because both "inside" and "better" are transitive, a single
containment test against all detections equals resolving them one after another; one
sweep over the intervals in order makes it, so a text of many detections takes no more
than its share.

Defined results: null and empty texts have 0 words, no label and score 0; texts are
scanned whole; repeated rows give repeated results; an empty table gives an empty result;
further columns pass through, the columns that are added replace those of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from segspark.llm._signatures import SIGNATURES

#: The phrases every scan reports, whatever else it finds.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: gate keywords (cut at |), name as words.  One of the keywords is part of every form
#: of the name.
LICENSES = {
    "mit": ("mit|expat", "mit|expat|x11 mit"),
    "apache-2": ("apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    "apache-1": ("apache", r"apache(?: software)?(?: license)?(?: version)? 1(?: [01])?"),
    "gpl-2": ("gpl", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    "gpl-3": ("gpl", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    "lgpl-2": ("lgpl", r"(?:gnu )?lgpl ?v?2(?: [01])?(?: only| or later)?"),
    "lgpl-3": ("lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?(?: only| or later)?"),
    "agpl-3": ("agpl", r"(?:gnu )?agpl ?v?3(?: 0)?(?: only| or later)?"),
    "gpl-2-long": ("general public", r"gnu general public license(?: as published by the free software foundation)?(?: either)? version 2"),
    "gpl-3-long": ("general public", r"gnu general public license(?: as published by the free software foundation)?(?: either)? version 3"),
    "lgpl-long": ("general public", r"gnu (?:lesser|library) general public license"),
    "agpl-long": ("general public", r"gnu affero general public license"),
    "bsd-2": ("bsd", r"(?:simplified |freebsd )bsd|bsd 2 clause|2 clause bsd|two clause bsd"),
    "bsd-3": ("bsd", r"(?:new |modified |revised )bsd|bsd 3 clause|3 clause bsd|three clause bsd"),
    "bsd-4": ("bsd", r"(?:original |old )bsd|bsd 4 clause|4 clause bsd"),
    "bsd-0": ("bsd", r"zero clause bsd|0bsd|bsd zero clause"),
    "isc": ("isc", r"isc"),
    "mpl-1": ("mpl", r"mpl ?v?1(?: [01])?"),
    "mpl-2": ("mpl", r"mpl ?v?2(?: 0)?"),
    "mpl-long": ("mozilla public", r"mozilla public license(?: version)?(?: [12] [01])?"),
    "epl-1": ("epl", r"epl ?v?1(?: 0)?"),
    "epl-2": ("epl", r"epl ?v?2(?: 0)?"),
    "epl-long": ("eclipse public", r"eclipse public license(?: version)?(?: v)?(?: [12](?: 0)?)?"),
    "cddl": ("cddl", r"cddl(?: ?v?1(?: [01])?)?"),
    "cddl-long": ("common development", r"common development and distribution license"),
    "unlicense": ("unlicense", r"unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl(?: version 2)?"),
    "zlib": ("zlib", r"zlib(?: libpng)?"),
    "bsl-1": ("boost software", r"boost software license(?: version)?(?: 1 0)?"),
    "artistic-2": ("artistic", r"artistic(?: license)?(?: version)? 2(?: 0)?"),
    "artistic-1": ("artistic", r"(?:perl )?artistic(?: license)?(?: version)? 1(?: 0)?"),
    "psf": ("python software", r"python software foundation"),
    "python-2": ("python", r"python license 2(?: 0)?"),
    "ruby": ("ruby", r"ruby"),
    "php": ("php", r"php(?: license)?(?: version)? 3(?: 01?)?"),
    "eupl": ("eupl", r"eupl(?: v?1 [012])?"),
    "eupl-long": ("european union", r"european union public licen[cs]e"),
    "ofl-1": ("ofl", r"(?:sil )?ofl(?: ?v?1 [01])?"),
    "ofl-long": ("open font", r"(?:sil )?open font license(?: version)?(?: 1 [01])?"),
    "odbl": ("odbl", r"odbl(?: ?v?1(?: 0)?)?"),
    "odbl-long": ("open database", r"open database license"),
    "odc-by": ("odc", r"odc by(?: 1 0)?"),
    "pddl": ("pddl", r"pddl(?: 1 0)?"),
    "cc0": ("cc0", r"cc0(?: 1 0)?(?: universal)?"),
    "cc-by": ("cc by", r"cc by(?: [1234] \d)?"),
    "cc-by-sa": ("cc by", r"cc by sa(?: [1234] \d)?"),
    "cc-by-nd": ("cc by", r"cc by nd(?: [1234] \d)?"),
    "cc-by-nc": ("cc by", r"cc by nc(?: [1234] \d)?"),
    "cc-by-nc-sa": ("cc by", r"cc by nc sa(?: [1234] \d)?"),
    "cc-by-nc-nd": ("cc by", r"cc by nc nd(?: [1234] \d)?"),
    "cc-by-long": ("creative commons", r"creative commons attribution(?: [1234] \d)?(?: international| unported)?"),
    "cc-by-sa-long": ("creative commons", r"creative commons attribution share ?alike(?: [1234] \d)?(?: international| unported)?"),
    "cc-by-nc-long": ("creative commons", r"creative commons attribution non ?commercial(?: [1234] \d)?(?: international| unported)?"),
    "cc-by-nd-long": ("creative commons", r"creative commons attribution no ?deriv(?:s|atives)(?: [1234] \d)?"),
    "cc0-long": ("creative commons", r"creative commons (?:zero|cc0)(?: [1] 0)?(?: universal)?"),
    "ms-pl": ("microsoft public", r"microsoft public"),
    "ms-rl": ("microsoft reciprocal", r"microsoft reciprocal"),
    "osl-3": ("open software", r"open software license(?: version)?(?: v)?(?: 3 0)?"),
    "afl-3": ("academic free", r"academic free license(?: version)?(?: v)?(?: 3 0)?"),
    "upl-1": ("universal permissive", r"universal permissive license(?: version)?(?: v)?(?: 1 0)?"),
    "ncsa": ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    "openssl": ("openssl", r"openssl"),
    "curl": ("curl", r"curl"),
    "vim": ("vim", r"vim"),
    "postgresql": ("postgresql", r"postgresql"),
    "gfdl": ("gfdl", r"(?:gnu )?gfdl(?: ?v?1 [123])?"),
    "gfdl-long": ("free documentation", r"gnu free documentation license(?: version)?(?: 1 [123])?"),
    "sspl": ("server side public", r"server side public license"),
    "busl": ("business source", r"business source license(?: version)?(?: 1 1)?"),
    "elastic-2": ("elastic license", r"elastic license(?: 2 0)?"),
    "openrail": ("openrail", r"(?:creativeml )?openrail(?: m)?"),
    "proprietary": ("proprietary", r"proprietary"),
}

#: Forms a name is met in: priority, strength, pattern around it.
FORMS = [
    ("tag", 1, 0.97, r"spdx license identifiers? (?:%s)"),
    ("grant", 2, 0.9, r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed) (?:\S+ ){0,3}?(?:under|by) (?:the )?(?:terms (?:of|and conditions of) (?:the )?)?(?:%s)(?: (?:public )?licen[cs]e)?"),
    ("title", 3, 0.7, r"(?:%s) (?:public )?licen[cs]e"),
    ("mention", 4, 0.4, r"licen[cs]e (?:type |name |is |the )?(?:%s)"),
]


@dataclass(frozen=True)
class Rule:
    """One signature: fires when a word of ``keyword`` (one, or several cut at |) is in the words
    and ``pattern`` matches whole words."""

    name: str
    label: str
    keyword: str
    pattern: str
    priority: int
    strength: float


def signature_rules() -> list[Rule]:
    """All rules, best priority first: base phrases, texts and links, then the forms of names."""
    rules = [Rule(f"base:{label}", label, phrase, phrase, 0, 0.9) for phrase, label in BASE.items()]
    rules += [Rule(f"text:{i}:{label}", label, keyword, pattern, 1, strength) for i, (label, keyword, pattern, strength) in enumerate(SIGNATURES)]
    for label, (keyword, name) in LICENSES.items():
        rules += [Rule(f"{form}:{label}", label.removesuffix("-long"), keyword, around % name, priority, strength) for form, priority, strength, around in FORMS]
    # A bare short identifier of several words says enough by itself.
    rules += [Rule(f"id:{label}", label, keyword, name, 5, 0.5) for label, (keyword, name) in LICENSES.items() if " " in keyword or keyword in ("cc0", "wtfpl", "lgpl", "agpl", "odbl", "proprietary")]
    return sorted(rules, key=lambda r: r.priority)


_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in range(0x30, 0x3A) or b in range(0x61, 0x7B) or b >= 0x80 else 0x20 for b in range(256))


class Scanner:
    """Runs gated rules over one text; a small helper inside tasks."""

    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.rules, self.gate, by = rules, ahocorasick.Automaton(), {}
        for i, rule in enumerate(rules):
            for keyword in rule.keyword.split("|"):
                by.setdefault(keyword, []).append(i)
        for keyword, which in by.items():
            self.gate.add_word(keyword, which)
        self.gate.make_automaton()
        # Words hold no ASCII blanks, so with re.A a \\S is any character of a word.
        self.compiled = [re.compile(rf"(?<= )(?:{r.pattern})(?= )", re.A) for r in rules]

    def scan(self, text: bytes) -> tuple[int, list[dict]]:
        words = text.translate(_FOLD).split()
        if not words:
            return 0, []
        line = f" {b' '.join(words).decode('utf-8')} "
        active = {i for _, which in self.gate.iter(line) for i in which}
        found, blanks = [], None
        for i in sorted(active):
            rule = self.rules[i]
            for m in self.compiled[i].finditer(line):
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 0x20)
                start = int(np.searchsorted(blanks, m.start())) - 1
                found.append({"rule": rule.name, "label": rule.label, "start": start, "end": start + m.group().count(" ") + 1, "priority": rule.priority, "strength": rule.strength})
        suppress(found)
        return len(words), found


def suppress(found: list[dict]) -> None:
    """Set ``kept`` of each detection: no other of better priority covers it, nor a longer one
    of its own priority.  One sweep by start, longest first."""
    order = sorted(range(len(found)), key=lambda i: (found[i]["start"], -found[i]["end"], found[i]["priority"]))
    reach: dict[int, int] = {}  # how far those before reach, by priority
    at = 0
    while at < len(order):
        same = [order[at]]
        first = found[order[at]]
        while at + len(same) < len(order) and (x := found[order[at + len(same)]])["start"] == first["start"] and x["end"] == first["end"]:
            same.append(order[at + len(same)])
        at += len(same)
        best = found[same[0]]["priority"]
        for i in same:
            x = found[i]
            x["kept"] = x["priority"] == best and not any(end >= x["end"] for p, end in reach.items() if p <= x["priority"])
        for i in same:
            reach[found[i]["priority"]] = max(reach.get(found[i]["priority"], -1), first["end"])


DETECTIONS = ArrayType(
    StructType(
        [
            StructField("rule", StringType()),
            StructField("label", StringType()),
            StructField("start", LongType()),
            StructField("end", LongType()),
            StructField("priority", IntegerType()),
            StructField("strength", DoubleType()),
            StructField("kept", BooleanType()),
        ]
    )
)
_ARROW = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("strength", pa.float64()), ("kept", pa.bool_())]))


@lru_cache(maxsize=2)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(list(rules))


def detect(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` without its text, with ``n_words`` and all ``detections`` (``end`` exclusive)."""
    rules = tuple(signature_rules() if rules is None else rules)
    own = [f for f in docs.schema.fields if f.name not in ("n_words", "detections", text)]
    schema = StructType([*own, StructField("n_words", LongType()), StructField("detections", DETECTIONS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = None
        for batch in batches:
            scanner = scanner or _scanner(rules)
            found = [scanner.scan(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(len(own)).cast(pa.large_binary())]
            columns = [*batch.columns[: len(own)], pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], _ARROW)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.select(*(F.col(f"`{f.name}`") for f in own), F.col(f"`{text}`")).mapInArrow(scan, schema)


def resolve(detected: DataFrame) -> DataFrame:
    """Adds ``kept`` (not suppressed), ``labels`` and ``score`` to the output of :func:`detect`."""
    kept = F.filter("detections", lambda x: x["kept"])
    labels = F.array_join(F.array_sort(F.array_distinct(F.transform(F.col("kept"), lambda x: x["label"]))), ",")
    doubt = F.aggregate(F.col("kept"), F.lit(1.0), lambda a, x: a * (1.0 - x["strength"]))
    return detected.withColumn("kept", kept).withColumn("labels", labels).withColumn("score", F.round(1.0 - doubt, 6))


def license_scan(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """License detections, labels and score of every document."""
    return resolve(detect(docs, text, rules))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter(F.col("detections"), lambda x: x["rule"].startswith("base:"))
    starts = F.transform(F.col("base"), lambda x: x["start"])
    names = F.array_sort(F.array_distinct(F.transform(F.col("base"), lambda x: x["label"])))
    return (
        license_scan(docs)
        .withColumn("base", base)
        .select(
            "doc_id",
            "n_words",
            F.size("base").cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            F.array_join(names, ",").alias("base_labels"),
            "labels",
            "score",
        )
    )
