r"""License scan by ordered signature rules, in built-in functions only.

A few hundred hand-written patterns, each gated by the strings that its every match
holds (read off the pattern): a text is looked at by a rule only if it holds them all. Every detection is an interval of the
text. Detections inside a longer one are dropped, and those that overlap one of a
better class (an identifier or URL before a notice, a notice before a bare name).
Beside the rules, four base phrases are looked for word by word.

Texts that hold no rule's strings cost one scan and plain searches; of the others, each distinct text is
matched once, however many documents share it.

Defined results: null text counts as empty; a text without words has none of
anything, null positions and score 0; of equal intervals the rule listed first wins;
rows that repeat are scanned alike; other columns are ignored; no documents, no rows.
"""

from __future__ import annotations

import re
from re import _constants, _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirwise.llm.common import bind, text_or_empty
from dirwise.llm.lines import lower_ascii

# What separates words in a text as it is, and the base phrases.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_SCORE = 0.9

#: label; names of the license as patterns (a space stands for any gap, # for a version number), separated by " ; ".
NAMES = """
gpl-3.0; gpl ?-?v?3(?:\\.0)?\\b ; gnu gpl,? (?:version |v)3
gpl-3.0; general public licen[cs]e,? (?:version |v)3
gpl-2.0; gpl ?-?v?2(?:\\.0)?\\b ; gnu gpl,? (?:version |v)2
gpl-2.0; general public licen[cs]e,? (?:version |v)2
gpl-1.0; gpl ?-?v?1(?:\\.0)?\\b
gpl; gnu general public licen[cs]e ; general public licen[cs]e,? version 2 or later
gpl; (?:the )?gnu gpl\\b ; gpl-compatible ; gpl licen[cs]ed?\\b
lgpl-3.0; lgpl ?-?v?3(?:\\.0)?\\b
lgpl-2.1; lgpl ?-?v?2\\.1\\b
lgpl-2.0; lgpl ?-?v?2(?:\\.0)?\\b(?!\\.1)
lgpl; (?:gnu )?lesser general public licen[cs]e
lgpl; (?:gnu )?library general public licen[cs]e
lgpl; gnu lgpl\\b ; lgpl licen[cs]ed?\\b
agpl-3.0; agpl ?-?v?3(?:\\.0)?\\b
agpl; (?:gnu )?affero general public licen[cs]e
agpl; gnu agpl\\b ; agpl licen[cs]ed?\\b
gfdl; (?:gnu )?free documentation licen[cs]e
gfdl; gfdl ?-?v?#
apache-2.0; apache licen[cs]e,? (?:version |v)2(?:\\.0)? ; apache ?-?2\\.0\\b ; apache 2 licen[cs]e
apache-1.1; apache (?:software )?licen[cs]e,? (?:version |v)1\\.1 ; apache-1\\.1\\b
apache-1.0; apache (?:software )?licen[cs]e,? (?:version |v)1\\.0 ; apache-1\\.0\\b
apache; apache licen[cs]e ; apache software licen[cs]e ; licen[cs]ed under apache\\b
mit; (?:the )?mit licen[cs]e ; mit/x11 licen[cs]e ; mit-licen[cs]ed ; (?:licen[cs]e|licen[cs]ed under)(?: the)?:? mit\\b ; expat/mit
mit; expat licen[cs]e
mit-0; mit no attribution ; mit-0\\b
x11; x11 licen[cs]e
bsd-2-clause; (?:2|two)-clause (?:\\"?simplified\\"? )?bsd ; simplified bsd licen[cs]e ; freebsd licen[cs]e ; bsd-2-clause
bsd-3-clause; (?:3|three)-clause bsd ; (?:new|modified|revised) bsd licen[cs]e ; bsd-3-clause
bsd-4-clause; (?:4|four)-clause bsd ; original bsd licen[cs]e ; bsd-4-clause
0bsd; zero-clause bsd ; 0bsd\\b
bsd; bsd licen[cs]e ; bsd-style licen[cs]e ; bsd-licen[cs]ed
isc; isc licen[cs]e ; (?:licen[cs]e|licen[cs]ed under)(?: the)?:? isc\\b
mpl-2.0; mpl ?-?v?2(?:\\.0)?\\b
mpl-1.1; mpl ?-?v?1\\.1\\b
mpl-2.0; mozilla public licen[cs]e,? (?:version |v)?2(?:\\.0)?
mpl-1.1; mozilla public licen[cs]e,? (?:version |v)?1\\.1
mpl; mozilla public licen[cs]e
epl-2.0; epl ?-?v?2(?:\\.0)?\\b
epl-1.0; epl ?-?v?1(?:\\.0)?\\b
epl-2.0; eclipse public licen[cs]e,? (?:- )?(?:version |v)2(?:\\.0)?
epl; eclipse public licen[cs]e
edl; eclipse distribution licen[cs]e
cddl-1.0; cddl ?-?v?1\\.0\\b
cddl-1.1; cddl ?-?v?1\\.1\\b
cddl; common development and distribution licen[cs]e
cpl-1.0; common public licen[cs]e
ipl-1.0; ibm public licen[cs]e
eupl-1.2; eupl ?-?v?1\\.2\\b
eupl-1.1; eupl ?-?v?1\\.1\\b
eupl; european union public licen[cs]e
artistic-2.0; artistic licen[cs]e,? (?:version )?2(?:\\.0)? ; artistic-2\\.0\\b
artistic; artistic licen[cs]e
perl; same terms as perl(?: itself)?
python-2.0; python software foundation licen[cs]e ; psf licen[cs]e ; python licen[cs]e\\b
php-3.01; php licen[cs]e,? (?:version )?3\\.01
php; php licen[cs]e
ruby; ruby(?:'s)? licen[cs]e ; same terms as ruby
zlib; zlib licen[cs]e ; zlib/libpng licen[cs]e ; (?:licen[cs]e|licen[cs]ed under)(?: the)?:? zlib\\b
libpng; libpng licen[cs]e
openssl; openssl licen[cs]e
boost-1.0; boost software licen[cs]e(?:,? version 1\\.0)?
bsl-1.0; bsl-1\\.0\\b
busl-1.1; business source licen[cs]e(?: 1\\.1)?
sspl-1.0; server side public licen[cs]e
sspl-1.0; sspl ?-?v?1(?:\\.0)?\\b
elastic-2.0; elastic licen[cs]e(?: 2\\.0)?
unlicense; the unlicen[cs]e ; unlicen[cs]e\\b
wtfpl; wtfpl\\b ; do what the f[u*]ck you want to public licen[cs]e
beerware; beer-?ware licen[cs]e
cc0-1.0; cc0(?: 1\\.0)?(?: universal)?\\b ; creative commons cc0
cc0-1.0; creative commons zero
public-domain; (?:released|placed|dedicated) (?:in|into|to) the public domain ; public domain dedication ; in the public domain
pddl; pddl\\b
odbl-1.0; odbl(?: ?-?v?1\\.0)?\\b
odbl-1.0; open database licen[cs]e
odc-by-1.0; odc-by\\b
odc-by-1.0; open data commons attribution licen[cs]e
cc-by-nc-nd; cc by nc nd(?: #)? ; cc-by-nc-nd(?:-#)?
cc-by-nc-sa; cc by nc sa(?: #)? ; cc-by-nc-sa(?:-#)?
cc-by-nc; cc by nc\\b(?: #)? ; cc-by-nc(?:-#)?\\b
cc-by-nd; cc by nd\\b(?: #)? ; cc-by-nd(?:-#)?\\b
cc-by-sa; cc by sa\\b(?: #)? ; cc-by-sa(?:-#)?\\b
cc-by; cc by\\b(?: #)? ; cc-by(?:-#)?\\b
cc-by-nc-nd; creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa; creative commons attribution non ?commercial share ?alike
cc-by-nc; creative commons attribution non ?commercial
cc-by-nd; creative commons attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-sa; creative commons attribution share ?alike
cc-by; creative commons attribution
cc; creative commons licen[cs]e
afl-3.0; academic free licen[cs]e(?:,? (?:version |v)?#)?
osl-3.0; open software licen[cs]e(?:,? (?:version |v)?#)?
ofl-1.1; sil ofl(?: 1\\.1)? ; ofl-1\\.1\\b
ofl-1.1; (?:sil )?open font licen[cs]e(?:,? version 1\\.1)?
upl-1.0; universal permissive licen[cs]e
ncsa; (?:university of illinois/)?ncsa open source licen[cs]e
w3c; w3c software (?:notice and )?licen[cs]e
unicode; unicode licen[cs]e agreement ; unicode licen[cs]e v3
icu; icu licen[cs]e
curl; curl licen[cs]e
postgresql; postgresql licen[cs]e
vim; vim licen[cs]e
tcl; tcl/tk licen[cs]e
ms-pl; microsoft public licen[cs]e
ms-pl; ms-pl\\b
ms-rl; microsoft reciprocal licen[cs]e
ms-rl; ms-rl\\b
mulanpsl-2.0; mulan (?:permissive software licen[cs]e|psl)(?:,? v?2)?
cecill; cecill(?:-[bc]|-2\\.[01])?\\b
lppl-1.3c; lppl(?: ?-?1\\.3c?)?\\b
lppl-1.3c; latex project public licen[cs]e
sleepycat; sleepycat licen[cs]e
intel; intel open source licen[cs]e
nasa-1.3; nasa open source agreement
qpl-1.0; q public licen[cs]e
rpl-1.5; reciprocal public licen[cs]e
spl-1.0; sun public licen[cs]e
zpl-2.1; zope public licen[cs]e(?:,? (?:version |v)?#)?
ecl-2.0; educational community licen[cs]e(?:,? version 2\\.0)?
fair; fair licen[cs]e
json; the software shall be used for good, not evil
commons-clause; commons clause(?: licen[cs]e condition)?
polyform; polyform (?:non ?commercial|small business|shield|perimeter) licen[cs]e
hippocratic; hippocratic licen[cs]e
openrail; (?:bigscience |creativeml )?open ?rail(?:-m|\\+\\+-m)?(?: licen[cs]e)?
llama; llama (?:# )?community licen[cs]e
proprietary; all rights reserved
proprietary; proprietary and confidential ; proprietary licen[cs]e
"""
#: label; wording of notices and license texts.
NOTICES = """
gpl; under the terms of the gnu (?:general public licen[cs]e|gpl) as published by the free software foundation
gpl; either version # of the licen[cs]e,? or (?:\\(at your option\\) )?any later version
gpl; you should have received a copy of the gnu general public licen[cs]e
lgpl; you should have received a copy of the gnu lesser general public licen[cs]e
agpl; you should have received a copy of the gnu affero general public licen[cs]e
apache-2.0; licen[cs]ed under the apache licen[cs]e,? version 2\\.0
apache-2.0; you may not use this file except in compliance with the licen[cs]e
mit; permission is hereby granted,? free of charge,? to any person obtaining a copy
mit; the above copyright notice and this permission notice shall be included in all copies or substantial portions
isc; permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
bsd; redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd-3-clause; neither the name of [\\s\\S]{1,80}? may be used to endorse or promote products
bsd-4-clause; all advertising materials mentioning features or use of this software must display
zlib; this software is provided 'as-is',? without any express or implied warranty
boost-1.0; obtaining a copy of the software and accompanying documentation covered by this licen[cs]e
mpl-2.0; this source code form is subject to the terms of the mozilla public licen[cs]e
epl; this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
unlicense; this is free and unencumbered software released into the public domain
wtfpl; you just do what the f[u*]ck you want to
cc; (?:this work is )?licen[cs]ed under a creative commons
proprietary; this (?:document|file|work) is confidential and proprietary
copyright; copyright (?:\\(c\\)|©)?,? ?(?:19|20)\\d\\d ; \\(c\\) (?:copyright )?(?:19|20)\\d\\d ; © (?:copyright )?(?:19|20)\\d\\d
"""
#: SPDX identifiers; each gives a rule for its tag.
TAGS = """
gpl-1.0-only gpl-1.0-or-later gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1-only
lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 mit mit-0 x11 bsd-2-clause
bsd-3-clause bsd-4-clause 0bsd isc mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cddl-1.1 cpl-1.0 eupl-1.1 eupl-1.2 artistic-1.0 artistic-2.0
python-2.0 php-3.01 ruby zlib libpng openssl bsl-1.0 busl-1.1 sspl-1.0 elastic-2.0 unlicense wtfpl beerware cc0-1.0 cc-by-3.0 cc-by-4.0
cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 pddl-1.0 odbl-1.0 odc-by-1.0 afl-3.0 osl-3.0 ofl-1.1
upl-1.0 ncsa w3c postgresql vim ms-pl ms-rl cecill-2.1 lppl-1.3c ecl-2.0
"""
#: label; part of a URL.
URLS = """
gpl-3.0; gnu.org/licenses/gpl-3.0
gpl-2.0; gnu.org/licenses/gpl-2.0
gpl; gnu.org/licenses/gpl
lgpl; gnu.org/licenses/lgpl
agpl; gnu.org/licenses/agpl
gfdl; gnu.org/licenses/fdl
apache-2.0; apache.org/licenses/license-2.0
mit; opensource.org/licenses/mit
bsd-3-clause; opensource.org/licenses/bsd-3-clause
bsd-2-clause; opensource.org/licenses/bsd-2-clause
isc; opensource.org/licenses/isc
mpl-2.0; mozilla.org/mpl/2.0
epl-2.0; eclipse.org/legal/epl-2.0
boost-1.0; boost.org/license_1_0
unlicense; unlicense.org
cc0-1.0; creativecommons.org/publicdomain/zero
public-domain; creativecommons.org/publicdomain/mark
cc-by-nc-nd; creativecommons.org/licenses/by-nc-nd
cc-by-nc-sa; creativecommons.org/licenses/by-nc-sa
cc-by-nc; creativecommons.org/licenses/by-nc/
cc-by-nd; creativecommons.org/licenses/by-nd
cc-by-sa; creativecommons.org/licenses/by-sa
cc-by; creativecommons.org/licenses/by/
odbl-1.0; opendatacommons.org/licenses/odbl
ofl-1.1; scripts.sil.org/ofl
wtfpl; wtfpl.net
"""
GAP = r"[\\s\\-_,.\"'()/:;*#>]{1,40}".replace("\\\\", "\\")
NUMBER = r"\d+(?:\.\d+)?"


def held_strings(pattern: str) -> list[str]:
    """Strings that every match of a pattern holds, longest first: its literal runs outside of optional parts and alternatives."""
    runs = [""]

    def walk(items) -> None:
        for op, value in items:
            if op is _constants.LITERAL:
                runs[-1] += chr(value)
            elif op is _constants.SUBPATTERN:
                walk(value[3])
            else:
                runs.append("")

    walk(_parser.parse(pattern))
    return sorted({x for x in runs if x.strip()}, key=lambda x: (-len(x), x))


def rules() -> list[tuple[int, int, str, str, str, float]]:
    """rank (order of the list), class (0 best), label, key string (in every match), pattern over lower-cased text, weight."""
    out: list[tuple[int, str, str, float]] = []
    spaced = lambda x: x.replace("#", NUMBER).replace(" ?", f"(?:{GAP})?").replace(" ", GAP)
    for x in TAGS.split():
        out.append((0, x.removesuffix("-only").removesuffix("-or-later"), rf"spdx-license-identifier:\s*\(?{re.escape(x)}\b(?![-.]\w)", 0.99))
    for line in URLS.strip().splitlines():
        label, place = line.split("; ")
        out.append((0, label, re.escape(place), 0.98))
    for line in NOTICES.strip().splitlines():
        label, *patterns = re.split("; | ; ", line)
        out += [(1, label, rf"(?<!\w){spaced(p)}", 0.3 if label == "copyright" else 0.95) for p in patterns]
    for line in NAMES.strip().splitlines():
        label, *patterns = re.split("; | ; ", line)
        out += [(2, label, rf"(?<![\w-]){spaced(p)}", 0.5 if label == "proprietary" else 0.8) for p in patterns]
    key = lambda strings: next((x for x in strings if x != "licen"), strings[0])
    return [(i, x[0], x[1], key(held_strings(x[2])), *x[2:]) for i, x in enumerate(out)]


CC_BY = f"(?i)cc{GAPS}by"


#: Where the longest of a gate's strings is shorter, it stands in too many words, and the pattern itself is looked for.
TELLING = 6


def gates() -> list[tuple[tuple[str, ...], str | None]]:
    """Strings of which every detection's text holds all of one entry, and a pattern to look for then. ("cc" has ``CC_BY``.)"""
    out: dict[tuple[str, ...], str | None] = {("licen",): None}
    for _, _, _, word, pattern, _ in rules():
        strings = held_strings(pattern)
        if word != "cc" and not any("licen" in x for x in strings):
            some = tuple(strings[:3])
            short = len(some[0]) < TELLING
            out[some] = "|".join(filter(None, (out.get(some), pattern))) if short else None
    return list(out.items())


def may_hold(text: Column) -> Column:
    """Cheap test that a text needs the rules: plain searches of the lower-cased text, patterns only where these succeed."""
    def any_gate(low: Column) -> Column:
        hit = F.lit(False)
        for strings, pattern in gates():
            all_in = F.lit(True)
            for x in strings:
                all_in = all_in & F.contains(low, F.lit(x))
            hit = hit | (all_in & text.rlike(f"(?i){pattern}") if pattern else all_in)
        return hit

    return bind(F.lower(text), any_gate) | text.rlike(CC_BY)


def _places(words: Column, phrase: str) -> Column:
    """Where a phrase's words stand one after the other."""
    parts = phrase.split()
    same = lambda i: [F.get(words, i + j) == p for j, p in enumerate(parts)]

    def fits(i: Column) -> Column:
        first, *rest = same(i)
        for x in rest:
            first = first & x
        return F.coalesce(first, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))), fits)


def detections(texts: DataFrame) -> DataFrame:
    """``texts`` (key, low: lower-cased): key, label, weight, start, stop of every detection that is left."""
    listed = [(*x, held_strings(x[4])) for x in rules()]
    table = texts.sparkSession.createDataFrame(listed, "rank int, class int, label string, word string, pattern string, weight double, strings array<string>")
    words = F.array(*[F.lit(w) for w in sorted({r[3] for r in rules()})])
    held = texts.select("key", "low", F.explode(F.filter(words, lambda w: F.contains(F.col("low"), w))).alias("word"))
    tried = held.join(F.broadcast(table), "word").where(F.forall("strings", lambda x: F.contains(F.col("low"), x)))  # the rules above: a few hundred rows
    met = tried.select("key", "rank", "class", "label", "weight", "low", "pattern", F.expr("regexp_extract_all(low, pattern, 0)").alias("met")).where("size(met) > 0")
    spans = met.select("key", "rank", "class", "label", "weight", F.posexplode(F.arrays_zip(F.transform("met", lambda m: F.length(m)).alias("long"), F.transform(F.expr("split(low, pattern, -1)"), lambda x: F.length(x)).alias("gap"))).alias("n", "x")).where("x.long is not null")
    run = Window.partitionBy("key", "rank").orderBy("n")
    stops = spans.withColumn("stop", F.sum(F.col("x.long") + F.col("x.gap")).over(run)).select("key", "rank", "class", "label", "weight", (F.col("stop") - F.col("x.long")).alias("start"), "stop")
    outer = Window.partitionBy("key").orderBy("start", F.desc("stop"), "rank")
    before, from_end = outer.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key").orderBy(F.desc("start"), "stop", F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    widest = stops.withColumn("inside", F.coalesce(F.max("stop").over(before) >= F.col("stop"), F.lit(False))).where("not inside").drop("inside")
    for better in (0, 1):  # what overlaps an interval of a better class goes, best class first
        of = F.when(F.col("class") <= better, F.col("stop")), F.when(F.col("class") <= better, F.col("start"))
        hit = (F.col("class") > better) & (F.coalesce(F.max(of[0]).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(of[1]).over(from_end) < F.col("stop"), F.lit(False)))
        widest = widest.withColumn("hit", hit).where("not hit").drop("hit")
    return widest


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    text = text_or_empty(text_col)
    cut = F.split(F.col("text"), GAPS, -1)
    counted = bind(cut, lambda a: F.size(a) - (F.get(a, F.lit(0)) == "").cast("int") - ((F.size(a) > 1) & (F.get(a, F.size(a) - 1) == "")).cast("int"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    words = F.filter(F.split(lower_ascii(F.col("text")), GAPS, -1), lambda w: w != "")
    phrases = list(BASE)
    places = bind(words, lambda w: F.array(*[_places(w, p) for p in phrases]))
    none = F.array(*[F.array().cast("array<int>") for _ in phrases])
    key = F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    phrased = F.contains(F.lower("text"), F.lit("license")) | F.col("text").rlike(CC_BY)
    based = rows.select("id", key.alias("key"), counted.cast("long").alias("n_words"), F.when(phrased, places).otherwise(none).alias("places"))
    found = rows.where(may_hold(F.col("text"))).select(key.alias("key"), lower_ascii(F.col("text")).alias("low")).dropDuplicates(["key"])
    summed = detections(found).groupBy("key").agg(F.collect_set("label").alias("own"), (1 - F.exp(F.sum(F.log(1 - F.col("weight"))))).alias("sure"))
    joined = based.join(summed.select(F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2"), "own", "sure"), (F.col("key.h1") == F.col("h1")) & (F.col("key.h2") == F.col("h2")), "left")
    flat = F.flatten("places")
    base = F.array_compact(F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(BASE[p])) for i, p in enumerate(phrases)]))
    own = F.coalesce("own", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.size(flat).cast("long").alias("n_base"), F.array_min(flat).cast("long").alias("first_word"), F.array_max(flat).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.size(flat) > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
    )
