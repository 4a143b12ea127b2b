"""License mentions: ordered signature rules behind a keyword gate, overlaps resolved by priority.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.llm.lines import LOWER, UPPER
from reviewlens.llm.text import whole_text

# Phrases that are always counted, with their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Words near which signatures are looked for: every signature holds one of them. Those with a verb
# need not name a license, but say "under"; so does nothing but "subject" in "subject to the". Bare
# identifiers hold their own name.
KEYWORDS = [
    "license", "licence", "licensed", "licenced", "licenses", "licences", "licensing", "spdx",
    "copyleft", "under", "subject",
    "permission", "redistribution", "redistribute", "warranty", "warranties", "domain", "commons",
    "copyright", "unlicense", "cc0", "cc", "gpl",
]

# Words on either side of a keyword in which a signature may stand: the longest one, a copyright line
# of one-letter words, has its last word 35 behind the keyword.
CONTEXT = 35

# label; words of which every mention has one; how the license is called; its identifiers, as words.
_LICENSES = [
    ("mit", "mit", "(?:mit|mit x11|mit expat)", "mit"),
    ("mit-0", "mit", "mit (?:0|no attribution)", "mit 0"),
    ("apache-1.1", "apache", "apache (?:software )?(?:license )?(?:version |v)?1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?", "apache 2 0"),
    ("gpl", "gpl", "(?:gnu )?gpl", "gpl"),
    ("gpl-1.0", "gpl gpl1 gplv1", "(?:gnu )?(?:gpl ?v?1|gpl version 1)(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "gpl gpl2 gplv2", "(?:gnu )?(?:gpl ?v?2|gpl version 2)(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "gpl gpl3 gplv3", "(?:gnu )?(?:gpl ?v?3|gplv3|gpl version 3)(?: 0)?", "gpl 3 0"),
    ("gpl-2.0", "gnu", "gnu general public license (?:as published by the free software foundation )?(?:version |v)2", "gpl 2 0 only"),
    ("gpl-3.0", "gnu", "gnu general public license (?:as published by the free software foundation )?(?:version |v)3", "gpl 3 0 only"),
    ("gpl-2.0-or-later", "gnu", "gnu general public license (?:version |v)2 or(?: at your option)? (?:any )?later", "gpl 2 0 or later"),
    ("gpl-3.0-or-later", "gnu", "gnu general public license (?:version |v)3 or(?: at your option)? (?:any )?later", "gpl 3 0 or later"),
    ("gpl-2.0-or-later", "gpl gpl2 gplv2", "(?:gnu )?(?:gpl ?v?2|gpl version 2)(?: 0)? or (?:any )?later", "gpl 2 0 or later"),
    ("gpl-3.0-or-later", "gpl gpl3 gplv3", "(?:gnu )?(?:gpl ?v?3|gpl version 3)(?: 0)? or (?:any )?later", "gpl 3 0 or later"),
    ("lgpl-2.1", "lgpl lgpl2 lgplv2", "(?:gnu )?(?:lgpl ?v?2|lgpl version 2)(?: 1)?", "lgpl 2 1"),
    ("lgpl-3.0", "lgpl lgpl3 lgplv3", "(?:gnu )?(?:lgpl ?v?3|lgpl version 3)(?: 0)?", "lgpl 3 0"),
    ("lgpl", "lesser lgpl", "(?:gnu )?(?:lesser general public|lgpl)", "lgpl"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public", "agpl 3 0"),
    ("agpl", "agpl agpl3 agplv3", "(?:gnu )?agpl(?: ?v?3)?(?: 0)?", "agpl"),
    ("gfdl", "documentation", "gnu free documentation", "gfdl 1 3"),
    ("bsd-2-clause", "bsd", "(?:(?:2 clause|two clause|simplified|freebsd) bsd|bsd (?:2|two) clause)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:(?:3 clause|three clause|new|revised|modified) bsd|bsd (?:3|three) clause)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:(?:4 clause|four clause|original|old) bsd|bsd (?:4|four) clause)", "bsd 4 clause"),
    ("bsd", "bsd", "bsd(?: style)?", "bsd"),
    ("0bsd", "bsd", "(?:zero clause|0 clause|free public) bsd", "0bsd"),
    ("mpl", "mpl", "mpl", "mpl"),
    ("mpl-1.1", "mozilla mpl mpl1 mplv1", "(?:mozilla public license (?:version |v)?1 1|(?:mpl ?v?1|mpl version 1) 1)", "mpl 1 1"),
    ("mpl-2.0", "mozilla mpl mpl2 mplv2", "(?:mozilla public(?: license (?:version |v)?2 0)?|(?:mpl ?v?2|mpl version 2)(?: 0)?)", "mpl 2 0"),
    ("epl", "epl", "epl", "epl"),
    ("epl-1.0", "eclipse epl epl1 eplv1", "(?:eclipse public license (?:version |v)?1 0|(?:epl ?v?1|epl version 1)(?: 0)?)", "epl 1 0"),
    ("epl-2.0", "eclipse epl epl2 eplv2", "(?:eclipse public(?: license (?:version |v)?2 0)?|(?:epl ?v?2|epl version 2)(?: 0)?)", "epl 2 0"),
    ("cddl", "cddl distribution", "(?:cddl|common development and distribution)", "cddl 1 0"),
    ("cpl", "common", "common public", "cpl 1 0"),
    ("isc", "isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("boost", "boost", "boost(?: software)?", "bsl 1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl fuck", "(?:wtfpl|do what the fuck you want to public)", "wtfpl"),
    ("artistic", "artistic", "(?:perl )?artistic(?: license)?(?: 2 0)?", "artistic 2 0"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("python", "python", "python(?: software foundation)?", "psf 2 0"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("ofl", "sil", "sil open font", "ofl 1 1"),
    ("eupl", "eupl european", "(?:eupl|european union public)", "eupl 1 2"),
    ("cc0", "cc0 zero", "(?:cc0|cc0 1 0|creative commons zero)", "cc0 1 0"),
    ("cc-by", "creative cc", "(?:creative commons|cc) (?:by|attribution)(?: [1-4] 0)?", "cc by 4 0"),
    ("cc-by-sa", "creative cc", "(?:creative commons|cc) (?:by sa|attribution share ?alike)(?: [1-4] 0)?", "cc by sa 4 0"),
    ("cc-by-nc", "creative cc", "(?:creative commons|cc) (?:by nc|attribution non ?commercial)(?: [1-4] 0)?", "cc by nc 4 0"),
    ("cc-by-nd", "creative cc", "(?:creative commons|cc) (?:by nd|attribution no ?deriv(?:ative)?s)(?: [1-4] 0)?", "cc by nd 4 0"),
    ("cc-by-nc-sa", "creative cc", "(?:creative commons|cc) (?:by nc sa|attribution non ?commercial share ?alike)(?: [1-4] 0)?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "creative cc", "(?:creative commons|cc) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] 0)?", "cc by nc nd 4 0"),
    ("ms-pl", "microsoft", "microsoft public", "ms pl"),
    ("proprietary", "proprietary", "proprietary", "licenseref proprietary"),
]

_VERB = "(?:licen[sc]ed|released|distributed|available|provided|published|offered|made available)"
_LIC = "licen[sc]e"
# The ways a license is mentioned, the most telling first: (priority, confidence, pattern).
_FORMS = [
    (2, 1.0, "spdx license identifier {spdx}"),
    (3, 0.95, "{verb} under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: {lic})?"),
    (4, 0.9, "subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: {lic})?"),
    (5, 0.85, "(?:see|read|refer to|under) (?:the )?{name} {lic}(?: for (?:more )?details)?"),
    (6, 0.8, "{name} {lic}"),
    (7, 0.6, "{lic}s?(?: is| type| name)? (?:the )?{name}"),
]

# Sentences of license texts themselves: (label, words of which each has one, priority, confidence,
# pattern).
_TEXTS = [
    ("mit", "hereby", 1, 1.0, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "hereby", 1, 0.9, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "binary", 1, 1.0, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", 1, 0.9, "(?:names? of its )?contributors may (?:not )?be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "redistribute", 1, 0.95, "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", 1, 0.97, "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "redistribute", 1, 0.97, "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "fitness", 5, 0.5, "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("apache-2.0", "compliance", 1, 1.0, "you may not use this file except in compliance with the license"),
    ("mpl-2.0", "mozilla", 1, 1.0, "subject to the terms of the mozilla public license"),
    ("zlib", "implied", 1, 0.8, "provided as is without any express or implied warranty"),
    ("boost", "organization", 1, 0.9, "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", "unencumbered", 1, 1.0, "free and unencumbered software released into the public domain"),
    ("public-domain", "public", 6, 0.7, "(?:in|into|to) the public domain"),
    ("cc0", "dedicate dedicated", 1, 0.8, "dedicated? (?:all |any )?(?:copyright|the work|this work) (?:interest )?to the public domain"),
    ("proprietary", "rights", 8, 0.4, "copyright (?:c )?(?:[0-9]{4} )?.{0,60}all rights reserved"),
    ("gpl", "gnu", 6, 0.8, "gnu general public licen[sc]e"),
    ("apache", "apache", 6, 0.75, "apache (?:software )?licen[sc]e"),
    ("creative-commons", "creative", 6, 0.7, "creative commons (?:[a-z0-9]+ ){0,6}licen[sc]e"),
]

# Mentions of single licenses that fit no form: versions behind the word license, several licenses in
# one sentence, and bare identifiers. Those that name a second license stand behind the forms, or
# they would take the mention of the other one with them.
_MENTIONS = [
    ("apache", "apache", 5, 0.7, "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?apache(?: software)?"),
    ("apache-2.0", "apache", 6, 0.9, "apache (?:software )?licen[sc]e (?:version |v)?2(?: 0)?"),
    ("gpl-2.0", "gnu", 6, 0.9, "gnu general public licen[sc]e (?:version |v)2(?: 0)?"),
    ("gpl-3.0", "gnu", 6, 0.9, "gnu general public licen[sc]e (?:version |v)3(?: 0)?"),
    ("gpl-2.0-or-later", "gnu", 6, 0.9, "gnu general public licen[sc]e (?:version |v)2(?: 0)? or (?:any )?later"),
    ("gpl-3.0-or-later", "gnu", 6, 0.9, "gnu general public licen[sc]e (?:version |v)3(?: 0)? or (?:any )?later"),
    ("gpl-2.0-or-later", "gpl", 6, 0.8, "gpl (?:version |v)?2(?: 0)? or (?:any )?later"),
    ("gpl-3.0-or-later", "gpl", 6, 0.8, "gpl (?:version |v)?3(?: 0)? or (?:any )?later"),
    ("lgpl-2.1", "lesser", 6, 0.9, "lesser general public licen[sc]e (?:version |v)?2 1"),
    ("lgpl-3.0", "lesser", 6, 0.9, "lesser general public licen[sc]e (?:version |v)?3(?: 0)?"),
    ("agpl-3.0", "affero", 6, 0.9, "affero general public licen[sc]e (?:version |v)?3(?: 0)?"),
    ("cc-by", "cc", 6, 0.7, "cc by [1-4] 0"),
    ("cc-by-sa", "cc", 6, 0.7, "cc by sa [1-4] 0"),
    ("cc-by-nc", "cc", 6, 0.7, "cc by nc [1-4] 0"),
    ("cc-by-nd", "cc", 6, 0.7, "cc by nd [1-4] 0"),
    ("cc-by-nc-sa", "cc", 6, 0.7, "cc by nc sa [1-4] 0"),
    ("cc-by-nc-nd", "cc", 6, 0.7, "cc by nc nd [1-4] 0"),
    ("apache-2.0", "apache", 7, 0.85, "licen[sc]ed under (?:the )?(?:mit|bsd|isc|zlib|gpl)(?: licen[sc]e)? (?:and|or) (?:the )?apache(?: licen[sc]e)?(?: version)? v?2(?: 0)?"),
    ("apache", "apache", 8, 0.7, "licen[sc]ed under (?:the )?(?:mit|bsd|isc|zlib|gpl)(?: licen[sc]e)? (?:and|or) (?:the )?apache"),
    ("mit", "mit", 7, 0.85, "licen[sc]ed under (?:the )?(?:apache(?: licen[sc]e)?(?: version)?(?: v?2)?(?: 0)?|bsd|isc|gpl) (?:and|or) (?:the )?mit"),
    ("bsd", "bsd", 7, 0.85, "licen[sc]ed under (?:the )?(?:apache(?: licen[sc]e)?(?: version)?(?: v?2)?(?: 0)?|mit|isc|gpl) (?:and|or) (?:the )?bsd"),
    ("gpl", "gpl", 7, 0.85, "licen[sc]ed under (?:the )?(?:mit|bsd|mpl|lgpl|apache)(?: licen[sc]e)? (?:and|or) (?:the )?(?:gnu )?gpl"),
    ("apache-2.0", "apache", 6, 0.75, "apache (?:version )?v?2(?: 0)? licen[sc]es"),
    ("mit", "mit", 7, 0.8, "mit (?:and|or) (?:the )?(?:apache(?: v?2)?(?: 0)?|bsd|gpl) licen[sc]es?"),
    ("bsd", "bsd", 7, 0.8, "bsd (?:and|or) (?:the )?(?:apache(?: v?2)?(?: 0)?|mit|gpl) licen[sc]es?"),
]


def signature_rules() -> list[tuple[int, str, str, int, float, str]]:
    """(rule, label, gate word, priority, confidence, pattern) of all rules, in order.

    Every license is mentioned in every form; the texts' own sentences come on top. Every match of a
    pattern holds one of its gate words, and a pattern with several is a rule under each of them. An
    identifier need not hold the words of the name, so its first word is its gate.
    """
    rows = [
        (label, spdx.split()[0] if "{spdx}" in form else gates, priority, confidence, form.format(name=name, spdx=spdx, verb=_VERB, lic=_LIC))
        for priority, confidence, form in _FORMS
        for label, gates, name, spdx in _LICENSES
    ]
    ordered = sorted([*_TEXTS, *_MENTIONS, *[(r[0], r[1], r[2], r[3], r[4]) for r in rows]], key=lambda r: r[2])
    return [
        (number, label, gate, priority, confidence, f"(?<![^ ])(?:{pattern})(?![^ ])")
        for number, (label, gate, priority, confidence, pattern) in enumerate(
            (label, gate, *rest) for label, gates, *rest in ordered for gate in gates.split()
        )
    ]


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        signature_rules(),
        "rule int, label string, gate string, priority int, confidence double, pattern string",
    )


def word_line(text: Column) -> Column:
    """The text's words in a row, one space between: runs of ASCII letters, digits and all that is
    not ASCII, with A-Z as a-z."""
    lower = F.translate(text, UPPER, LOWER)
    return F.btrim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _count(text: Column, part: str) -> Column:
    """How often ``part`` occurs, without overlaps."""
    gone = F.length(F.replace(text, F.lit(part), F.lit("")))
    return ((F.length(text) - gone) / len(part)).cast("long")


def _phrase_columns(line: Column) -> dict[str, Column]:
    """Places of the phrases; each word stands between spaces of its own, so places cannot overlap."""
    spaced = F.concat(F.lit(" "), F.replace(line, F.lit(" "), F.lit("  ")), F.lit(" "))
    gate = line.contains("license")
    total, firsts, lasts, labels = [], [], [], []
    n_words = F.when(line == "", 0).otherwise(_count(line, " ") + 1)
    for phrase, label in PHRASES.items():
        wide = f" {phrase.replace(' ', '  ')} "
        at = F.when(gate, F.locate(wide, spaced)).otherwise(0)
        back = F.when(gate, F.locate(wide[::-1], F.reverse(spaced))).otherwise(0)
        found = at > 0
        before = F.substring(spaced, F.lit(1), at - 1)
        behind = F.substring(F.reverse(spaced), F.lit(1), back - 1)
        total.append(F.when(found, _count(spaced, wide)).otherwise(0))
        firsts.append(F.when(found, F.floor(_count(before, " ") / 2)))
        lasts.append(
            F.when(found, n_words - F.floor(_count(behind, " ") / 2) - len(phrase.split()))
        )
        labels.append(F.when(found, F.lit(label)))
    return {
        "n_words": n_words.cast("long"),
        "n_base": sum(total[1:], total[0]).cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base": F.array_sort(F.array_compact(F.array(*labels))),
    }


# Stands before each match while a piece's matches are looked for; no word holds it.
MARK = "\x01"


def _places(piece: Column, pattern: Column) -> Column:
    """(start, stop), in words of the piece, of the pattern's match at each word where one begins.

    A look-ahead marks the places and copies the match behind the mark, so matches may overlap.
    """
    marked = F.regexp_replace(piece, F.concat(F.lit("(?=("), pattern, F.lit("))")), F.lit(f"{MARK}$1{MARK}"))
    # What is before the first match; then, in turn, a match and the text from its place on.
    parts = F.split(marked, MARK)
    spaces = F.transform(parts, lambda part: _count(part, " "))
    numbers = F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2))
    ends = F.when(F.size(parts) > 1, numbers).otherwise(F.array().cast("array<int>"))

    def before(k: Column) -> Column:
        """Spaces in the texts in front of the k-th part, without the matches."""
        texts = F.filter(F.slice(spaces, 1, k), lambda _, i: i % 2 == 0)
        return F.aggregate(texts, F.lit(0).cast("long"), lambda n, x: n + x)

    return F.transform(
        ends,
        lambda k: F.struct(
            before(k).alias("start"), (before(k) + F.get(spaces, k) + 1).alias("stop")
        ),
    )


def detect(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Detections that stand, as (d, c, label, confidence, start, stop), in words of the document.

    ``docs``: d, c (which row it is) and line (its words). Around each keyword, CONTEXT words to
    either side are cut out; a rule is tried there only if its gate word is among them, and gives the
    match at each word where one begins; what is found is the same as in the whole text. A detection falls if another one of the same document that begins earlier (or
    at the same word and is no shorter) contains it and has the same or a better priority.
    """
    gate = F.concat(F.lit(" "), F.col("line"), F.lit(" ")).rlike(f" (?:{'|'.join(KEYWORDS)}) ")
    words = docs.where(gate).select("d", "c", F.split("line", " ").alias("words"))
    keyword = F.transform("words", lambda w, i: F.when(w.isin(KEYWORDS), i))
    near = words.select("d", "c", "words", F.explode(F.array_compact(keyword)).alias("at")).select(
        "d", "c",
        F.greatest(F.col("at") - CONTEXT, F.lit(0)).alias("from"),
        F.slice(
            "words",
            F.greatest(F.col("at") - CONTEXT, F.lit(0)) + 1,
            F.least(F.col("at"), F.lit(CONTEXT)) + CONTEXT + 1,
        ).alias("near"),
    )
    tried = near.select(
        "d", "c", "from", F.array_join("near", " ").alias("piece"),
        F.explode(F.array_distinct("near")).alias("gate"),
    ).join(F.broadcast(rules), "gate")  # the rules are a fixed list of some hundreds
    places = _places(F.col("piece"), F.col("pattern"))
    hits = tried.where(F.rlike("piece", F.col("pattern"))).select(
        "d", "c", "rule", "label", "priority", "confidence", "from", F.explode(places).alias("at")
    )
    spans = hits.select(
        "d", "c", "rule", "label", "priority", "confidence",
        (F.col("from") + F.col("at.start")).alias("start"),
        (F.col("from") + F.col("at.stop")).alias("stop"),
    ).distinct()
    order = Window.partitionBy("d", "c").orderBy("start", F.desc("stop"), "priority", "rule")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    classes = sorted({rule[3] for rule in signature_rules()})
    # For each priority, how far the earlier detections of that priority or a better one reach.
    reach = F.coalesce(
        *[
            F.when(
                F.col("priority") == p,
                F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(earlier),
            )
            for p in classes
        ]
    )
    kept = spans.withColumn("reach", reach).where("reach IS NULL OR reach < stop")
    return kept.select("d", "c", "label", "confidence", "start", "stop")


def scan_licenses(docs: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """License phrases and signatures in whole texts.

    ``docs``: doc_id, text. Result, one row per row: doc_id, n_words, n_base (places of PHRASES),
    first_word and last_word (the smallest and largest start of one, in words from 0, else null), base
    (their labels), labels (those and the rules'), detections (label, confidence, start, stop), score
    (the best confidence; 0.8 for a phrase, 0 for nothing).

    Only texts with a keyword reach the rules, and a rule is tried only where its gate word stands,
    so the regular expressions see short pieces of few texts. Null and empty texts have no words.
    Repeated rows give repeated results; ids may be null or come with several texts, as texts are told
    apart by a hash. Other columns are ignored; no documents, no rows.
    """
    own = rules if rules is not None else rules_table(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id"), F.xxhash64(whole_text()).alias("content"), word_line(whole_text()).alias("line")
    )
    found = detect(
        rows.select(F.col("doc_id").alias("d"), F.col("content").alias("c"), "line").distinct(), own
    )
    by_doc = found.groupBy("d", "c").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop", "label", "confidence"))).alias("detections")
    )
    base = rows.select("doc_id", "content", *[c.alias(n) for n, c in _phrase_columns(F.col("line")).items()])
    joined = base.join(
        by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")), "left"
    )
    none = F.array().cast("array<struct<start:bigint,stop:bigint,label:string,confidence:double>>")
    all_found = F.coalesce("detections", none)
    confidence = F.coalesce(F.array_max(F.transform(all_found, lambda x: x["confidence"])), F.lit(0.0))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_distinct("base").alias("base"),
        F.array_sort(F.array_union("base", F.transform(all_found, lambda x: x["label"]))).alias("labels"),
        all_found.alias("detections"),
        F.greatest(confidence, F.when(F.col("n_base") > 0, 0.8).otherwise(0.0)).alias("score"),
    )
