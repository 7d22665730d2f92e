"""License notices by ordered signature rules, as column expressions only.

A rule is a label, a rank, a keyword and a regular expression. A document is first searched for
the keywords; only rules whose keyword it has run their expression over it. Matches are
intervals of the text. An interval inside one of a rule of the same or a better rank is
suppressed, so that "GNU Lesser General Public License" is not also the general one. The running
furthest end per rank over the intervals in order of start decides that. Licenses are known by SPDX
tags, by grants and names, by addresses, and by sentences of their own texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import let, matches, running, without

#: The phrases of the contract and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
WORDS = WORD + "+"

#: Licenses by label: names as expressions, SPDX ids, web addresses.
FAMILIES: tuple[tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...]], ...] = (
    ("mit", ("mit license", "massachusetts institute of technology license"), ("mit",), ("opensource.org/licenses/mit", "mit-license.org")),
    ("apache-2", ("apache license,? version 2(?:\\.0)?", "apache software license,? version 2(?:\\.0)?", "apache 2\\.0 license"), ("apache-2\\.0",), ("apache.org/licenses/license-2.0",)),
    ("apache-1", ("apache software license,? version 1\\.[01]",), ("apache-1\\.[01]",), ("apache.org/licenses/license-1",)),
    ("gpl-3", ("gnu general public license,? (?:version|v)\\.? ?3", "general public license v3", "gplv3"), ("gpl-3\\.0(?:-only|-or-later)?",), ("gnu.org/licenses/gpl-3",)),
    ("gpl-2", ("gnu general public license,? (?:version|v)\\.? ?2", "general public license v2", "gplv2"), ("gpl-2\\.0(?:-only|-or-later)?",), ("gnu.org/licenses/gpl-2",)),
    ("gpl", ("gnu general public license", "gnu gpl"), ("gpl",), ("gnu.org/licenses/gpl",)),
    ("lgpl-3", ("gnu lesser general public license,? (?:version|v)\\.? ?3", "lgplv3"), ("lgpl-3\\.0(?:-only|-or-later)?",), ("gnu.org/licenses/lgpl-3",)),
    ("lgpl-2.1", ("gnu lesser general public license,? (?:version|v)\\.? ?2\\.1", "lgplv2\\.1"), ("lgpl-2\\.1(?:-only|-or-later)?",), ("gnu.org/licenses/lgpl-2.1",)),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license"), ("lgpl",), ("gnu.org/licenses/lgpl", "gnu.org/copyleft/lesser")),
    ("agpl-3", ("gnu affero general public license,? (?:version|v)\\.? ?3", "agplv3"), ("agpl-3\\.0(?:-only|-or-later)?",), ("gnu.org/licenses/agpl-3",)),
    ("agpl", ("gnu affero general public license", "affero general public license"), ("agpl",), ("gnu.org/licenses/agpl",)),
    ("gfdl", ("gnu free documentation license",), ("gfdl-1\\.[123](?:-only|-or-later)?",), ("gnu.org/licenses/fdl",)),
    ("bsd-3", ("bsd 3-clause license", "3-clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"), ("bsd-3-clause",), ("opensource.org/licenses/bsd-3-clause",)),
    ("bsd-2", ("bsd 2-clause license", "2-clause bsd license", "simplified bsd license", "freebsd license"), ("bsd-2-clause",), ("opensource.org/licenses/bsd-2-clause",)),
    ("bsd-4", ("bsd 4-clause license", "4-clause bsd license", "original bsd license"), ("bsd-4-clause",), ("directory.fsf.org/wiki/license:bsd-4clause",)),
    ("bsd-0", ("zero-clause bsd license", "bsd zero clause license"), ("0bsd",), ("opensource.org/licenses/0bsd",)),
    ("bsd", ("bsd-style license", "bsd license", "berkeley software distribution license"), ("bsd",), ("opensource.org/licenses/bsd-license",)),
    ("mpl-2", ("mozilla public license,? (?:version|v)\\.? ?2(?:\\.0)?",), ("mpl-2\\.0",), ("mozilla.org/mpl/2.0", "mozilla.org/en-us/mpl/2.0")),
    ("mpl-1", ("mozilla public license,? (?:version|v)\\.? ?1\\.[01]",), ("mpl-1\\.[01]",), ("mozilla.org/mpl/1",)),
    ("mpl", ("mozilla public license",), ("mpl",), ("mozilla.org/mpl",)),
    ("epl-2", ("eclipse public license,? (?:version|v|-)\\.? ?2(?:\\.0)?",), ("epl-2\\.0",), ("eclipse.org/legal/epl-2.0",)),
    ("epl-1", ("eclipse public license,? (?:version|v|-)\\.? ?1(?:\\.0)?",), ("epl-1\\.0",), ("eclipse.org/legal/epl-v10",)),
    ("edl", ("eclipse distribution license",), ("edl-1\\.0",), ("eclipse.org/org/documents/edl",)),
    ("cddl", ("common development and distribution license",), ("cddl-1\\.[01]",), ("opensource.org/licenses/cddl",)),
    ("cpl", ("common public license",), ("cpl-1\\.0",), ("opensource.org/licenses/cpl1",)),
    ("ipl", ("ibm public license",), ("ipl-1\\.0",), ("opensource.org/licenses/ipl",)),
    ("eupl", ("european union public licen[cs]e",), ("eupl-1\\.[012]",), ("joinup.ec.europa.eu/collection/eupl",)),
    ("isc", ("isc license",), ("isc",), ("opensource.org/licenses/isc",)),
    ("zlib", ("zlib license", "zlib/libpng license"), ("zlib",), ("opensource.org/licenses/zlib", "zlib.net/zlib_license")),
    ("libpng", ("libpng license",), ("libpng(?:-2\\.0)?",), ("libpng.org/pub/png/src/libpng-license",)),
    ("boost", ("boost software license",), ("bsl-1\\.0",), ("boost.org/license_1_0", "boost.org/users/license")),
    ("unlicense", ("the unlicense",), ("unlicense",), ("unlicense.org",)),
    ("wtfpl", ("do what the f\\w{3} you want to public license",), ("wtfpl",), ("wtfpl.net",)),
    ("artistic-2", ("artistic license,? (?:version )?2(?:\\.0)?",), ("artistic-2\\.0",), ("perlfoundation.org/artistic-license-20",)),
    ("artistic", ("artistic license",), ("artistic-1\\.0(?:-perl)?",), ("opensource.org/licenses/artistic",)),
    ("psf", ("python software foundation license",), ("psf-2\\.0", "python-2\\.0"), ("docs.python.org/3/license",)),
    ("php", ("php license",), ("php-3\\.0[01]?",), ("php.net/license",)),
    ("ruby", ("ruby license",), ("ruby",), ("ruby-lang.org/en/about/license",)),
    ("w3c", ("w3c software (?:notice and )?license",), ("w3c",), ("w3.org/consortium/legal",)),
    ("ofl", ("sil open font license",), ("ofl-1\\.[01]",), ("scripts.sil.org/ofl", "openfontlicense.org")),
    ("odbl", ("open database license",), ("odbl-1\\.0",), ("opendatacommons.org/licenses/odbl",)),
    ("odc-by", ("open data commons attribution license",), ("odc-by-1\\.0",), ("opendatacommons.org/licenses/by",)),
    ("pddl", ("public domain dedication and license",), ("pddl-1\\.0",), ("opendatacommons.org/licenses/pddl",)),
    ("postgresql", ("postgresql licen[cs]e",), ("postgresql",), ("opensource.org/licenses/postgresql",)),
    ("ncsa", ("university of illinois/ncsa open source license", "ncsa open source license"), ("ncsa",), ("opensource.org/licenses/ncsa",)),
    ("ms-pl", ("microsoft public license",), ("ms-pl",), ("opensource.org/licenses/ms-pl",)),
    ("ms-rl", ("microsoft reciprocal license",), ("ms-rl",), ("opensource.org/licenses/ms-rl",)),
    ("afl", ("academic free license",), ("afl-3\\.0",), ("opensource.org/licenses/afl-3.0",)),
    ("osl", ("open software license",), ("osl-3\\.0",), ("opensource.org/licenses/osl-3.0",)),
    ("bsl-1.1", ("business source license",), ("busl-1\\.1",), ("mariadb.com/bsl11",)),
    ("sspl", ("server side public license",), ("sspl-1\\.0",), ("mongodb.com/licensing/server-side-public-license",)),
    ("elastic-2", ("elastic license,? (?:version|v)?\\.? ?2(?:\\.0)?",), ("elastic-2\\.0",), ("elastic.co/licensing/elastic-license",)),
    ("openssl", ("openssl license",), ("openssl",), ("openssl.org/source/license",)),
    ("curl", ("curl license",), ("curl",), ("curl.se/docs/copyright",)),
    ("lppl", ("latex project public license",), ("lppl-1\\.3[ac]?",), ("latex-project.org/lppl",)),
    ("qpl", ("q public license",), ("qpl-1\\.0",), ("doc.qt.io/archives/3.3/license",)),
    ("cecill", ("cecill(?:-[bc])?(?: free software)? license(?: agreement)?",), ("cecill-(?:2\\.[01]|[bc])",), ("cecill.info/licences",)),
    ("cc0", ("cc0 1\\.0 universal", "creative commons zero"), ("cc0-1\\.0",), ("creativecommons.org/publicdomain/zero",)),
    ("cc-by-nc-nd", ("creative commons attribution[- ]noncommercial[- ]noderiv(?:ative)?s",), ("cc-by-nc-nd-[1-4]\\.[05]",), ("creativecommons.org/licenses/by-nc-nd",)),
    ("cc-by-nc-sa", ("creative commons attribution[- ]noncommercial[- ]sharealike",), ("cc-by-nc-sa-[1-4]\\.[05]",), ("creativecommons.org/licenses/by-nc-sa",)),
    ("cc-by-nc", ("creative commons attribution[- ]noncommercial",), ("cc-by-nc-[1-4]\\.[05]",), ("creativecommons.org/licenses/by-nc",)),
    ("cc-by-nd", ("creative commons attribution[- ]noderiv(?:ative)?s",), ("cc-by-nd-[1-4]\\.[05]",), ("creativecommons.org/licenses/by-nd",)),
    ("cc-by-sa", ("creative commons attribution[- ]sharealike",), ("cc-by-sa-[1-4]\\.[05]",), ("creativecommons.org/licenses/by-sa",)),
    ("cc-by", ("creative commons attribution", "cc by [1-4]\\.[05]"), ("cc-by-[1-4]\\.[05]",), ("creativecommons.org/licenses/by",)),
    ("public-domain", ("released into the public domain", "dedicated to the public domain", "(?:is|are) in the public domain"), (), ("creativecommons.org/publicdomain/mark",)),
    ("all-rights-reserved", ("all rights reserved",), (), ()),
    ("proprietary", ("proprietary and confidential", "confidential and proprietary"), ("licenseref-proprietary",), ()),
)


#: Sentences that stand in the licenses themselves or in the notices they ask for, as words.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3"),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3"),
    ("gfdl", "copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0"),
    ("epl-1", "made available under the terms of the eclipse public license v1 0"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("postgresql", "distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify"),
    ("wtfpl", "changing it is allowed as long as the name is changed"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("psf", "psf is making python available to licensee on an as is basis"),
    ("ofl", "this font software is licensed under the sil open font license"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("afl", "licensed under the academic free license version"),
    ("osl", "licensed under the open software license version"),
    ("cc0", "has dedicated the work to the public domain by waiving all of his or her rights"),
    ("odbl", "is made available under the open database license"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
)

#: Words too frequent to look a document up by; a rule's keyword is another word of its expression.
FREQUENT = frozenset("the of and is are in to into by you do what want new free all license licence public version software general".split())


@dataclass(frozen=True)
class Rule:
    label: str
    #: 0 for an SPDX tag, 1 for a base phrase, a grant or a sentence of the license, 2 for a name or an address.
    rank: int
    #: A word that stands, whole, in every match.
    keyword: str
    pattern: str
    base: bool = False


#: How sure a rank is.
SURE = (1.0, 0.9, 0.7)
_GRANTS = (r"(?:licen[cs]ed|released|distributed|available|made available|published)(?: to you)?(?: under)?(?: the)?"
           r"(?: terms(?: and conditions)? of)?(?: the)? ")


def _bounded(pattern: str) -> str:
    return f"(?<!{WORD}){pattern}(?!{WORD})"


def _loose(name: str) -> str:
    """Single blanks of a name stand for any white space."""
    return name.replace(" ", r"\s+")


def phrase(words: str) -> str:
    """Words standing consecutively, whatever ASCII stands between them."""
    return _bounded(f"{_GAP}+".join(map(re.escape, words.split(" "))))


def _keyword(name: str) -> str:
    """The longest whole word of a name that every match has, a frequent one only if there is no other."""
    apart = re.sub(r"\(\?:[^0-9a-z()][^()]*\)\??|\\\.", " ", name)  # groups that begin beside a word, not in it
    fixed = re.sub(r"[a-z0-9]*(?:\(\?:[^()]*\)|\[[^]]*\]|\\.)[?*+]?(?:\{\d\})?[a-z0-9]*", " ", apart)
    words = re.findall(r"[a-z][a-z0-9]+", fixed)
    return min(words, key=lambda w: (w in FREQUENT, -len(w), w))


def rules() -> list[Rule]:
    """All rules in order; the order settles what ranks and intervals leave open."""
    out = [Rule(label, 1, _keyword(words), phrase(words), base=True) for words, label in BASE]
    for label, names, tags, urls in FAMILIES:
        out += [Rule(label, 0, "spdx", _bounded(rf"spdx-license-identifier:\s*{t}(?![.-]*{WORD})")) for t in tags]
        for name in names:
            out.append(Rule(label, 1, _keyword(name), _bounded(_loose(_GRANTS + name))))
            out.append(Rule(label, 2, _keyword(name), _bounded(_loose(name))))
        out += [Rule(label, 1, _keyword(words), phrase(words)) for of, words in SENTENCES if of == label]
        out += [Rule(label, 2, _keyword(u.split("/")[0].rsplit(".", 1)[0].replace(".", " ")), _bounded(re.escape(u))) for u in urls]
    return out


def _table(of: list[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("no"), F.lit(r.label).alias("label"), F.lit(r.rank).alias("rank"), F.lit(r.keyword).alias("keyword"),
                              F.lit("(?i)" + r.pattern).alias("pattern"), F.lit(r.base).alias("base")) for i, r in enumerate(of)])


def scan_licenses(docs: DataFrame, of: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The documents with ``n_words``, ``notices`` (start, end, rank, label; suppressed ones left
    out), ``base`` (the same for base rules, none suppressed) and ``score``, how sure the best
    notice is, 0 without one.

    Null and empty texts have no word and no notice. Input columns named like the new ones are
    replaced; repeated rows are scanned each. Nothing moves between tasks, and no Python runs.
    """
    of = rules() if of is None else of
    docs = without(docs, "n_words", "notices", "base", "score", "_words", "_found")
    shown = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keywords = F.array(*map(F.lit, sorted({r.keyword for r in of})))
    counted = docs.withColumn("_words", F.regexp_extract_all(F.lower(shown), F.lit(WORDS), F.lit(0)))
    counted = counted.withColumns({"n_words": F.size("_words").cast("bigint"), "_words": F.array_intersect("_words", keywords)})
    asked = F.filter(_table(of), lambda r: F.array_contains("_words", r["keyword"]))
    places = F.array_sort(F.flatten(F.transform(asked, lambda r: F.transform(matches(shown, r["pattern"]), lambda p: F.struct(
        p["start"].alias("start"), (-p["end"]).alias("stop"), r["rank"].alias("rank"), r["no"].alias("no"), p["end"].alias("end"),
        r["label"].alias("label"), r["base"].alias("base"))))))
    none = F.array().cast("array<struct<start:int,stop:int,rank:int,no:int,end:int,label:string,base:boolean>>")
    found = counted.withColumn("_found", F.when(F.size("_words") > 0, places).otherwise(none))
    kind = "array<struct<start:int,end:int,rank:int,label:string>>"

    def apart(all_found: Column) -> Column:
        """Intervals that none before them, of the same or a better rank, reaches over."""
        ends = F.transform(all_found, lambda d: F.struct(*[F.when(d["rank"] <= k, d["end"]).otherwise(-1).alias(f"r{k}") for k in range(len(SURE))]))
        furthest = running(ends, lambda a, b: F.struct(*[F.greatest(a[f"r{k}"], b[f"r{k}"]).alias(f"r{k}") for k in range(len(SURE))]))

        def judged(reach: Column) -> Column:
            before = F.transform(all_found, lambda d, i: F.struct(d.alias("d"), F.get(reach, i - 1).alias("r")))
            own = lambda x: F.coalesce(F.array(*[x["r"][f"r{k}"] for k in range(len(SURE))])[x["d"]["rank"]], F.lit(-1))
            return F.transform(F.filter(before, lambda x: own(x) < x["d"]["end"]), lambda x: _notice(x["d"]))

        return let(furthest, judged)

    kept = F.when(F.size("_found") > 0, apart(F.col("_found"))).otherwise(F.array().cast(kind))
    base = F.transform(F.filter("_found", lambda d: d["base"]), _notice)
    judged = found.withColumns({"notices": kept, "base": base}).drop("_words", "_found")
    ranked = F.transform(F.concat("notices", "base"), lambda d: d["rank"])
    sure = F.element_at(F.array(*map(F.lit, SURE)), F.array_min(ranked) + 1)
    return judged.withColumn("score", F.when(F.size(ranked) > 0, sure).otherwise(F.lit(0.0)))


def _notice(d: Column) -> Column:
    return F.struct(d["start"].alias("start"), d["end"].alias("end"), d["rank"].alias("rank"), d["label"].alias("label"))


def words_before(position: Column, text: str = "text") -> Column:
    """Number of the word that starts at a position given in code points; null for null."""
    before = F.substring(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(1), position)
    return F.regexp_count(before, F.lit(WORDS)).cast("bigint")


def labels_of(notices: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(notices, lambda d: d["label"]))), ",")
