"""License scan: ordered signature rules over the words of a text.

A rule is a family's name in one of many wordings, as a regular expression over
the words. Three gates keep the work small: a text without any keyword is left
alone, a family is tried only where its keyword occurs, and a rule only where
its own literal part does. Detections are intervals of words. One that lies
within an interval of a rule of higher priority is suppressed (of equal
intervals and priorities the first rule stays); partial overlaps stay.

The three base phrases are counted apart and always keep their labels.

Everything is a column expression over one row: no shuffle, no Python. Null and
empty texts have no words and no labels (score 0); rows are handled one by
one, so repeated rows, empty tables and further columns need no care.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.llm.common import before_blocks, blanks, in_blocks, own_column, word_text

# Phrases and labels of the contract.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# keyword that each of the names contains, label, and the names a license goes by, as patterns over words
FAMILIES = (
    (" mit", "mit", ("mit",)),
    ("expat", "mit", ("expat",)),
    ("x11", "mit", ("x11",)),
    ("apache", "apache-2", ("apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?", "apache2")),
    ("apache", "apache-1.1", ("apache (?:software )?(?:license )?(?:version |v)?1 1",)),
    ("bsd", "bsd-2-clause", ("bsd 2 clause", "simplified bsd", "freebsd")),
    ("bsd", "bsd-3-clause", ("bsd 3 clause", "(?:new|modified|revised) bsd")),
    ("bsd", "bsd-4-clause", ("bsd 4 clause", "(?:original|old) bsd")),
    ("bsd", "0bsd", ("0bsd", "zero clause bsd")),
    ("gpl", "gpl-2", ("gplv2", "gpl (?:version |v)?2(?: 0)?")),
    ("gpl", "gpl-3", ("gplv3", "gpl (?:version |v)?3(?: 0)?")),
    ("general public", "gpl-2", ("gnu general public license (?:version |v)?2(?: 0)?",)),
    ("general public", "gpl-3", ("gnu general public license (?:version |v)?3(?: 0)?",)),
    ("general public", "gpl", ("gnu general public",)),
    ("lgpl", "lgpl-2.1", ("lgplv2(?: 1)?", "lgpl (?:version |v)?2(?: 1)?")),
    ("lgpl", "lgpl-3", ("lgplv3", "lgpl (?:version |v)?3(?: 0)?")),
    ("lesser general", "lgpl", ("gnu lesser general public", "lesser general public")),
    ("agpl", "agpl-3", ("agplv3", "agpl (?:version |v)?3(?: 0)?")),
    ("affero", "agpl-3", ("gnu affero general public", "affero gpl")),
    ("mozilla", "mpl-2", ("mozilla public (?:license )?(?:version |v)?2(?: 0)?",)),
    ("mozilla", "mpl-1.1", ("mozilla public (?:license )?(?:version |v)?1 1",)),
    ("mpl", "mpl-2", ("mpl (?:version |v)?2(?: 0)?", "mplv2")),
    ("eclipse", "epl-2", ("eclipse public (?:license )?(?:version |v)?2(?: 0)?",)),
    ("eclipse", "epl-1", ("eclipse public (?:license )?(?:version |v)?1(?: 0)?",)),
    ("cddl", "cddl-1", ("cddl(?: (?:version |v)?1(?: [01])?)?",)),
    ("boost", "bsl-1", ("boost software(?: license)?(?: (?:version |v)?1(?: 0)?)?",)),
    ("zlib", "zlib", ("zlib(?: libpng)?",)),
    ("isc", "isc", ("isc",)),
    ("artistic", "artistic-2", ("artistic (?:license )?(?:version |v)?2(?: 0)?", "perl artistic")),
    ("unlicense", "unlicense", ("unlicense",)),
    ("wtfpl", "wtfpl", ("wtfpl",)),
    ("postgresql", "postgresql", ("postgresql",)),
    ("python", "psf-2", ("python software foundation",)),
    ("psf", "psf-2", ("psf",)),
    ("sil open font", "ofl-1.1", ("sil open font",)),
    ("ofl", "ofl-1.1", ("ofl(?: 1 1)?",)),
    ("european union", "eupl-1.2", ("european union public",)),
    ("eupl", "eupl-1.2", ("eupl(?: (?:version |v)?1 2)?",)),
    ("microsoft", "ms-pl", ("microsoft public",)),
    ("ms pl", "ms-pl", ("ms pl",)),
    ("cc0", "cc0", ("cc0(?: 1 0)?(?: universal)?",)),
    ("cc by", "cc-by", ("cc by(?: [1-4] [0-9])?",)),
    ("cc by sa", "cc-by-sa", ("cc by sa(?: [1-4] [0-9])?",)),
    ("cc by nd", "cc-by-nd", ("cc by nd(?: [1-4] [0-9])?",)),
    ("cc by nc", "cc-by-nc", ("cc by nc(?: [1-4] [0-9])?",)),
    ("cc by nc sa", "cc-by-nc-sa", ("cc by nc sa(?: [1-4] [0-9])?",)),
    ("cc by nc nd", "cc-by-nc-nd", ("cc by nc nd(?: [1-4] [0-9])?",)),
    ("creative commons", "cc-by", ("creative commons attribution(?: [1-4] [0-9])?",)),
    ("creative commons", "cc-by-sa", ("creative commons attribution share ?alike",)),
    ("creative commons", "cc-by-nc", ("creative commons attribution non ?commercial",)),
    ("creative commons", "cc-by-nd", ("creative commons attribution no ?deriv(?:ative)?s?",)),
    ("creative commons", "cc-by-nc-sa", ("creative commons attribution non ?commercial share ?alike",)),
)

# priority, score, literal part, wording around a name
WORDINGS = (
    (90, 1.0, "spdx", "spdx license identifier {}"),
    (80, 0.95, "licen", "licen[sc]ed under (?:the )?{}(?: licen[sc]e)?"),
    (70, 0.9, "under the terms", "under the terms of (?:the )?{}(?: licen[sc]e)?"),
    (60, 0.9, "under", "(?:released|distributed|available|published|provided|used) under (?:the )?{}(?: licen[sc]e)?"),
    (50, 0.85, "subject to", "subject to (?:the )?(?:terms of )?(?:the )?{}(?: licen[sc]e)?"),
    (40, 0.8, "licen", "(?:the )?{} licen[sc]e"),
    (30, 0.7, "licen", "licen[sc]e {}"),
)
# names that mean a license without any wording around them
ALONE = {"gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3", "mpl-2", "cc0", "cc-by", "cc-by-sa", "cc-by-nd",
         "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "unlicense", "wtfpl", "apache-2"}
# texts of licenses and notices that name none
NOTICES = (
    ("permission is hereby granted", "mit", 85, 0.95, "permission is hereby granted free of charge to any person"),
    ("without warranty of any kind", "mit", 20, 0.5, "the software is provided as is without warranty of any kind"),
    ("redistribution and use", "bsd-3-clause", 85, 0.9, "redistribution and use in source and binary forms"),
    ("neither the name", "bsd-3-clause", 86, 0.9, "neither the name of .{1,80}? nor the names of its contributors"),
    ("unencumbered software", "unlicense", 85, 0.95, "free and unencumbered software released into the public domain"),
    ("permission to use copy", "isc", 85, 0.9, "permission to use copy modify and or distribute this software"),
    ("public domain", "public-domain", 35, 0.7, "(?:placed|dedicated|released|is) (?:in|to|into) the public domain"),
    ("all rights reserved", "proprietary", 15, 0.6, "all rights reserved"),
    ("confidential", "proprietary", 25, 0.7, "confidential and proprietary"),
    ("may not be reproduced", "proprietary", 25, 0.7, "may not be reproduced(?: or distributed)?"),
)


@dataclass(frozen=True)
class Rule:
    gate: str
    literal: str
    label: str
    priority: int
    score: float
    pattern: str


def rules() -> list[Rule]:
    """All rules in order: every name of every family in every wording."""
    out = [Rule(p, "", BASE[p], 100, 1.0, p) for p in BASE]
    for gate, label, names in FAMILIES:
        for name in names:
            out += [Rule(gate, lit, label, prio, score, form.format(name)) for prio, score, lit, form in WORDINGS]
            if label in ALONE:
                out.append(Rule(gate, "", label, 10, 0.6, name))
    out += [Rule(gate, "", label, prio, score, pattern) for gate, label, prio, score, pattern in NOTICES]
    return out


FOUND = "array<struct<label:string,priority:int,score:double,start:int,end:int,ord:int>>"


def _bounded(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _detections(words: Column, pattern: Column, label: Column, priority: Column, score: Column, ord_: Column) -> Column:
    """All places of one pattern as intervals of words."""
    pieces = F.call_function("split", words, pattern, F.lit(-1))
    found = F.regexp_extract_all(words, pattern, F.lit(0))

    def last_word(at: Column, row: Column) -> Column:
        return at + blanks(row["before"]) + F.coalesce(blanks(row["match"]), F.lit(0))

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + blanks(row["before"])
        size = blanks(row["match"]) + 1
        one = F.struct(label.alias("label"), priority.alias("priority"), score.alias("score"),
                       start.alias("start"), (start + size).alias("end"), ord_.alias("ord"))
        moved = F.struct((start + size - 1).alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))
        return F.when(row["match"].isNull(), acc).otherwise(moved)

    def scan(blocks: Column) -> Column:
        def of_block(starts: Column) -> Column:
            def run(block: Column, i: Column) -> Column:
                empty = F.struct(F.get(starts, i).alias("at"), F.array().cast(FOUND).alias("found"))
                return F.aggregate(block, empty, step, lambda acc: acc["found"])

            return F.flatten(F.transform(blocks, run))

        return let(before_blocks(blocks, F.lit(-1), last_word), of_block)

    return in_blocks(F.arrays_zip(pieces.alias("before"), found.alias("match")), scan)


def _by_family() -> dict[str, list[tuple[int, Rule]]]:
    out: dict[str, list[tuple[int, Rule]]] = {}
    for i, rule in enumerate(rules()):
        out.setdefault(rule.gate, []).append((i, rule))
    return out


# A word of every keyword; a keyword's leading blank only keeps it from the middle of words.
PREFILTER = "|".join(sorted({g.split()[0] for g in _by_family()}))


def _family(words: Column, members: list[tuple[int, Rule]]) -> Column:
    """Detections of the rules that share a keyword; a literal array of rules
    keeps the plan as small as one rule."""
    literal = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(r.literal).alias("literal"), F.lit(r.label).alias("label"),
                 F.lit(r.priority).alias("priority"), F.lit(r.score).alias("score"),
                 F.lit(_bounded(r.pattern)).alias("pattern"))
        for i, r in members
    ])
    tried = F.filter(literal, lambda r: words.contains(r["literal"]))
    return F.flatten(
        F.transform(tried, lambda r: _detections(words, r["pattern"], r["label"], r["priority"], r["score"], r["ord"]))
    )


def _kept(found: Column) -> Column:
    """Without the detections that lie within one of higher priority. Detections are
    compared by blocks in the order of their starts, and only with blocks that reach theirs."""

    def covers(e: Column, d: Column) -> Column:
        inside = (e["start"] <= d["start"]) & (d["end"] <= e["end"])
        above = (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (
            (e["end"] - e["start"] > d["end"] - d["start"])
            | ((e["end"] - e["start"] == d["end"] - d["start"]) & (e["ord"] < d["ord"]))
        ))
        return inside & above

    def reach(block: Column) -> Column:
        starts, ends = F.transform(block, lambda d: d["start"]), F.transform(block, lambda d: d["end"])
        return F.struct(
            F.array_min(starts).alias("first"), F.array_max(starts).alias("last"),
            F.array_min(ends).alias("least"), F.array_max(ends).alias("most"), block.alias("block"),
        )

    def unsuppressed(reaching: Column) -> Column:
        def of_block(own: Column) -> Column:
            near = F.filter(reaching, lambda r: (r["first"] <= own["last"]) & (r["most"] >= own["least"]))
            others = F.flatten(F.transform(near, lambda r: r["block"]))
            return let(others, lambda o: F.filter(own["block"], lambda d: ~F.exists(o, lambda e: covers(e, d))))

        return F.flatten(F.transform(reaching, of_block))

    by_start = F.transform(
        F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("at"), d.alias("d")))), lambda p: p["d"]
    )
    return in_blocks(by_start, lambda blocks: let(F.transform(blocks, reach), unsuppressed))


def scan(docs: DataFrame, text: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` with ``into``: the number of words and all detections that stay,
    as ``(label, priority, score, start, end, ord)`` by start."""
    words = own_column(docs, "words")
    found = own_column(docs, "found")
    families = _by_family()
    w = F.col(words)
    hits = F.concat(*[
        F.when(w.contains(gate), _family(w, members)).otherwise(F.array().cast(FOUND))
        for gate, members in families.items()
    ])
    anything = w.rlike(PREFILTER)
    ordered = F.array_sort(_kept(F.col(found)), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                           .otherwise(a["ord"] - b["ord"]))
    n = F.when(w == "  ", 0).otherwise(blanks(w) - 1).cast("long")
    return (
        docs.withColumn(words, word_text(F.col(text)))
        .withColumn(found, F.when(anything, hits).otherwise(F.array().cast(FOUND)))
        .withColumn(into, F.struct(n.alias("n_words"), F.col(found).alias("all"), ordered.alias("kept")))
        .drop(words, found)
    )


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The base phrases' places and all labels, per row."""
    base = F.filter("s.all", lambda d: d["ord"] < len(BASE))
    labels = F.array_sort(F.array_distinct(F.transform(F.concat("s.kept", "base"), lambda d: d["label"])))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda d: d["label"])))
    best = F.aggregate(F.concat("s.kept", "base"), F.lit(0.0), lambda acc, d: F.greatest(acc, d["score"]))
    return (
        scan(docs.select(key, text), text, "s")
        .select(key, "s", base.alias("base"))
        .select(
            key,
            F.col("s.n_words").alias("n_words"),
            F.size("base").cast("long").alias("n_base"),
            F.array_min(F.transform("base", lambda d: d["start"])).cast("long").alias("first_word"),
            F.array_max(F.transform("base", lambda d: d["start"])).cast("long").alias("last_word"),
            F.array_join(base_labels, ",").alias("base_labels"),
            F.array_join(labels, ",").alias("labels"),
            best.alias("score"),
            F.array_join(F.transform("s.kept", lambda d: F.concat_ws(":", d["label"], d["start"], d["end"])), ",")
            .alias("detections"),
        )
    )
