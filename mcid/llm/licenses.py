"""License detection by ordered signature rules, in Spark expressions only.

Method: texts without any keyword stem pass by. The others become a line of lower-case words; each rule
whose own keyword occurs there runs its pattern and gives word intervals. Intervals are then walked in order
of their start: one that lies inside an earlier one of equal or better priority is suppressed, so "the GNU
General Public License version 3" does not also count as a bare mention. The walk is linear.

Base phrases are counted apart and always keep their labels.

Cases: null or empty text has no words, no places, empty labels and score 0; repeated rows and ids keep
their rows; equal intervals of equal priority go to the first rule; an empty table gives no rows; other
columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of characters between words, and a word, before and after A-Z are lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

L = "licen[cs]e"
V = "(?:version |v)?"

#: Label, keyword, name. Names are patterns over lower-case words with single spaces.
FAMILIES = [
    ("mit", " mit ", f"mit {L}"),
    ("mit", " expat ", f"expat {L}"),
    ("apache-2", " apache", f"apache(?: software)?(?: {L})? {V}2(?: 0)?"),
    ("apache-1.1", " apache", f"apache(?: software)?(?: {L})? {V}1 1"),
    ("gpl-1", "general public", f"gnu general public {L} {V}1(?: 0)?"),
    ("gpl-2", "general public", f"gnu general public {L} {V}2(?: 0)?(?: or (?:any )?later)?"),
    ("gpl-3", "general public", f"gnu general public {L} {V}3(?: 0)?(?: or (?:any )?later)?"),
    ("gpl-2", " gpl", f"(?:gnu )?gpl {V}2(?: 0)?|gplv2"),
    ("gpl-3", " gpl", f"(?:gnu )?gpl {V}3(?: 0)?|gplv3"),
    ("lgpl-2.1", "lesser general", f"gnu lesser general public {L} {V}2 1"),
    ("lgpl-3", "lesser general", f"gnu lesser general public {L} {V}3(?: 0)?"),
    ("lgpl-2", "library general", f"gnu library general public {L} {V}2(?: 0)?"),
    ("lgpl", " lgpl", f"(?:gnu )?lgpl(?: {V}[23](?: [01])?)?"),
    ("agpl-3", "affero", f"(?:gnu )?affero general public {L} {V}3(?: 0)?"),
    ("agpl-3", " agpl", f"(?:gnu )?agpl {V}3(?: 0)?|agplv3"),
    ("bsd-2", " bsd", f"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: {L})?"),
    ("bsd-3", " bsd", f"(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: {L})?"),
    ("bsd-4", " bsd", f"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: {L})?"),
    ("bsd-0", " 0bsd", "0bsd"),
    ("isc", " isc ", f"isc {L}"),
    ("mpl-1.1", "mozilla public", f"mozilla public {L} {V}1 1"),
    ("mpl-2", "mozilla public", f"mozilla public {L} {V}2(?: 0)?"),
    ("mpl-2", " mpl", f"mpl {V}2(?: 0)?"),
    ("epl-1", "eclipse public", f"eclipse public {L} {V}1(?: 0)?"),
    ("epl-2", "eclipse public", f"eclipse public {L} {V}2(?: 0)?"),
    ("eupl-1.2", "european union public", f"european union public {L} {V}1 [12]"),
    ("cddl-1", "common development", f"common development and distribution {L}(?: {V}1 [01])?"),
    ("cpl-1", "common public", f"common public {L} {V}1(?: 0)?"),
    ("artistic-2", " artistic", f"artistic {L} {V}2(?: 0)?"),
    ("artistic-1", " artistic", f"artistic {L} {V}1(?: 0)?"),
    ("bsl-1", " boost", f"boost software {L}(?: {V}1(?: 0)?)?"),
    ("zlib", " zlib", f"zlib(?: libpng)? {L}"),
    ("unlicense", " unlicense", "unlicense"),
    ("wtfpl", " wtfpl", f"wtfpl(?: {V}2)?"),
    ("ofl-1.1", " open font", f"(?:sil )?open font {L}(?: {V}1 1)?"),
    ("odbl-1", " open database", f"open (?:data commons open )?database {L}(?: {V}1(?: 0)?)?"),
    ("python-2", " python software", f"python software foundation {L}(?: {V}2)?"),
    ("ms-pl", " microsoft public", f"microsoft public {L}"),
    ("bsl-1.1", " business source", f"business source {L}(?: {V}1 1)?"),
    ("sspl-1", " side public", f"server side public {L}(?: {V}1)?"),
    ("elastic-2", " elastic", f"elastic {L}(?: {V}2(?: 0)?)?"),
    ("cc0-1", " cc0", f"(?:creative commons )?cc0(?: {V}1(?: 0)?)?(?: universal)?"),
    ("cc-by-nc-nd", " nc nd", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", " nc sa", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", " by nc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", " by nd", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", " by sa", "cc by sa(?: [1-4] [05])?"),
    ("cc-by", " cc by", "cc by(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4] [05])?"),
    ("public-domain", "public domain", "public domain"),
    ("proprietary", "rights reserved", "all rights reserved"),
    ("bsd-2", " freebsd", f"freebsd {L}"),
    ("gpl-1", " gpl", f"(?:gnu )?gpl {V}1(?: 0)?|gplv1"),
    ("lgpl", " lgplv", "lgplv[23](?: [01])?"),
    *[(f"gpl-{k}", "general public", f"gnu general public {L} as published by the free software foundation (?:either )?{V}{k}(?: 0)?") for k in "123"],
    *[(f"gpl-{k}", "general public", f"{V}{k}(?: 0)? (?:or (?:any )?later )?of the gnu general public {L}") for k in "123"],
    ("lgpl-2.1", "lesser general", f"gnu lesser general public {L} as published by the free software foundation (?:either )?{V}2 1"),
    ("lgpl-3", "lesser general", f"gnu lesser general public {L} as published by the free software foundation (?:either )?{V}3(?: 0)?"),
    ("lgpl-2", "library general", f"gnu library general public {L} as published by the free software foundation (?:either )?{V}2(?: 0)?"),
    ("agpl-3", "affero", f"gnu affero general public {L} as published by the free software foundation (?:either )?{V}3(?: 0)?"),
    ("mpl-2", "mozilla public", f"mozilla public {L} v 2 0"),
    ("epl-1", "eclipse public", f"eclipse public {L} v 1 0"),
    ("epl-2", "eclipse public", f"eclipse public {L} v 2 0"),
]

#: Short ids: too common as words to count without one of the frames before them.
SHORT = [
    ("mit", " mit ", "mit"),
    ("isc", " isc ", "isc"),
    ("zlib", " zlib ", "zlib"),
    ("apache-1", " apache 1 0", "apache 1 0"),
    ("mpl-1.1", " mpl", f"mpl {V}1 1"),
    ("epl-1", " epl", f"epl {V}1(?: 0)?"),
    ("epl-2", " epl", f"epl {V}2(?: 0)?"),
    ("eupl-1.1", " eupl", f"eupl {V}1 1"),
    ("eupl-1.2", " eupl", f"eupl {V}1 2"),
    ("cddl-1", " cddl", f"cddl(?: {V}1(?: [01])?)?"),
    ("cpl-1", " cpl", f"cpl {V}1(?: 0)?"),
    ("artistic-1", " artistic", f"artistic {V}1(?: 0)?"),
    ("artistic-2", " artistic", f"artistic {V}2(?: 0)?"),
    ("bsl-1", " bsl", f"bsl {V}1 0"),
    ("bsl-1.1", " busl", f"busl {V}1 1"),
    ("ofl-1.1", " ofl", f"ofl(?: {V}1 1)?"),
    ("odbl-1", " odbl", f"odbl(?: {V}1 0)?"),
    ("python-2", " psf", f"psf {V}2(?: 0)?"),
    ("python-2", " python 2 0", "python 2 0"),
    ("ms-pl", " ms pl", "ms pl"),
    ("sspl-1", " sspl", f"sspl {V}1(?: 0)?"),
    ("elastic-2", " elastic", f"elastic {V}2(?: 0)?"),
]

#: Names without a version: low priority, so that any rule that knows the version covers them.
OPEN = [
    ("gpl", "general public", f"gnu general public {L}"),
    ("gpl", " gpl ", "(?:gnu )?gpl"),
    ("lgpl", "general public", f"(?:gnu )?(?:lesser|library) general public {L}"),
    ("agpl", "affero", f"(?:gnu )?affero general public {L}"),
    ("agpl", " agpl ", "(?:gnu )?agpl"),
    ("bsd", " bsd ", f"bsd {L}"),
    ("apache", " apache", f"apache(?: software)? {L}"),
    ("mpl", "mozilla public", f"mozilla public {L}"),
    ("epl", "eclipse public", f"eclipse public {L}"),
    ("eupl", "european union public", f"european union public {L}"),
    ("cpl", "common public", f"common public {L}"),
    ("artistic", " artistic", f"artistic {L}"),
]

#: Sentences of the license texts themselves: priority, label, keyword, words.
TEXTS = [
    (1, "mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    (1, "bsl-1", "permission is hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    (1, "isc", "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided"),
    (1, "bsd-0", "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    (3, "bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    (1, "bsd-3", "neither the name", "neither the names? of(?: [^ ]+){1,40}? may be used to endorse or promote products"),
    (1, "bsd-4", "all advertising materials", "all advertising materials mentioning features or use of this software"),
    (1, "zlib", "express or implied warranty", "without any express or implied warranty in no event will the authors? be held liable"),
    (1, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    (1, "wtfpl", "you want to public", f"do what the fuck you want to public {L}"),
]

#: Words before the name, priority (1 is best), score.
FRAMES = [
    ("licen[cs]ed under (?:the )?(?:terms of (?:the )?)?", 1, 1.0),
    ("(?:released|distributed|published|provided|available|offered) under (?:the )?(?:terms of (?:the )?)?", 1, 1.0),
    (f"spdx {L} identifier ", 1, 1.0),
    ("(?:subject to|governed by|covered by|dedicated to|placed in(?:to)?) (?:the )?(?:terms of (?:the )?)?", 2, 0.9),
    (f"{L} (?:is )?(?:the )?", 2, 0.8),
    ("", 3, 0.5),
]


def rule_table() -> list[tuple[int, str, str, str, float]]:
    """Priority, label, keyword, pattern, score of every rule: each name in each frame, best frames first."""
    named = [(p, label, key, f" {frame}(?:{name})(?= )", score) for frame, p, score in FRAMES for label, key, name in FAMILIES + (SHORT if frame else [])]
    texts = [(p, label, key, f" {words}(?= )", 1.0) for p, label, key, words in TEXTS]
    return named + texts + [(3, label, key, f" {frame}(?:{name})(?= )", 0.8 * score) for frame, _, score in FRAMES for label, key, name in OPEN]


#: Any keyword of a rule or base phrase contains one of these, before lowering.
STEMS = (
    r"(?i)licen[cs]|copyright|rights|public|general|creative|affero|mozilla|apache|artistic|boost|elastic|zlib|wtfpl|expat|open|permission|redistribution|neither the name|advertising materials|express or implied|unencumbered"
    r"|0bsd|(^|[^0-9A-Za-z\x80-\x{10FFFF}])(cc|cc0|mit|[al]?gpl\w*|bsd|freebsd|isc|mpl|epl|eupl|cddl|cpl|bsl|busl|ofl|odbl|psf|python|ms|sspl)([^0-9A-Za-z\x80-\x{10FFFF}]|$)"
)


def spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


HIT = "array<struct<a:int,z:int,p:int,r:int,label:string,score:double>>"


def hits(line: Column, rule: Column) -> Column:
    """Word intervals (first, end) of one rule's matches in a line of words."""
    pieces, found = F.split(line, rule["re"], -1), F.regexp_extract_all(line, rule["re"], F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + spaces(x["piece"])
        z = a + spaces(x["match"])
        hit = F.struct(a.alias("a"), z.alias("z"), rule["p"].alias("p"), rule["r"].alias("r"), rule["label"].alias("label"), rule["score"].alias("score"))
        return F.struct(z.alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {HIT})").alias("out"))
    return F.when(F.rlike(line, rule["re"]), F.aggregate(pairs, start, step)["out"]).otherwise(F.expr(f"cast(array() as {HIT})"))


def unsuppressed(found: Column) -> Column:
    """Hits, in order of start (longest first), that no earlier one of equal or better priority contains."""

    def step(acc: Column, x: Column) -> Column:
        ends = [acc[f"e{k}"] for k in (1, 2, 3)]
        best = F.when(x["p"] == 1, ends[0]).when(x["p"] == 2, F.greatest(*ends[:2])).otherwise(F.greatest(*ends))
        grown = [F.when(x["p"] == k, F.greatest(e, x["z"])).otherwise(e).alias(f"e{k}") for k, e in enumerate(ends, 1)]
        return F.struct(*grown, F.when(best >= x["z"], acc["out"]).otherwise(F.concat(acc["out"], F.array(x["h"]))).alias("out"))

    keyed = F.sort_array(F.transform(found, lambda h: F.struct(h["a"].alias("a"), (-h["z"]).alias("nz"), h["p"].alias("p"), h["r"].alias("r"), h["z"].alias("z"), h.alias("h"))))
    start = F.struct(*[F.lit(-1).alias(f"e{k}") for k in (1, 2, 3)], F.expr(f"cast(array() as {HIT})").alias("out"))
    return F.aggregate(keyed, start, step)["out"]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, hits (the kept intervals)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("t"))
    lower = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    line = F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), GAP, " ")
    df = df.select("doc_id", F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"), F.when(F.col("t").rlike(STEMS), line).otherwise(" ").alias("line"))
    for k, (phrase, _) in enumerate(BASE):
        found = F.when(F.contains("line", F.lit(f" {phrase} ")), F.split("line", f" {phrase}(?= )", -1))
        df = df.withColumn(f"b{k}", found)
    firsts, lasts, sizes, labels = [], [], [], []
    for k, (phrase, label) in enumerate(BASE):
        b = F.col(f"b{k}")
        sizes.append(F.when(b.isNotNull(), F.size(b) - 1).otherwise(0))
        firsts.append(spaces(F.get(b, F.lit(0))))
        lasts.append(F.col("n_words") - (spaces(F.element_at(b, -1)) - 1) - len(phrase.split()))
        labels.append(F.when(b.isNotNull(), F.lit(label)))
    groups: dict[str, list[Column]] = {}
    for i, (p, label, key, rx, score) in enumerate(rule_table()):
        groups.setdefault(key, []).append(F.struct(F.lit(p).alias("p"), F.lit(i).alias("r"), F.lit(label).alias("label"), F.lit(rx).alias("re"), F.lit(score).alias("score")))
    # each keyword is looked for once, however many rules it has
    table = F.array(*[F.struct(F.lit(key).alias("key"), F.array(*rules).alias("rules")) for key, rules in groups.items()])
    near = F.flatten(F.transform(F.filter(table, lambda g: F.contains(F.col("line"), g["key"])), lambda g: g["rules"]))
    df = df.select(
        "doc_id",
        "n_words",
        sum(sizes[1:], sizes[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
        F.when(F.col("line") != " ", F.flatten(F.transform(near, lambda r: hits(F.col("line"), r)))).alias("found"),
    )
    df = df.withColumn("hits", F.coalesce(unsuppressed(F.col("found")), F.expr(f"cast(array() as {HIT})"))).drop("found")
    top = F.aggregate("hits", F.lit(0.0), lambda m, h: F.greatest(m, h["score"]))
    return df.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("base", F.transform("hits", lambda h: h["label"])))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(top).alias("score"),
        "hits",
    )
