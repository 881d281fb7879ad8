"""License detection by ordered signature rules.

Rules are regular expressions over the text with A-Z lower-cased. A rule runs only on
texts that hold all words of one of its keywords. Rules have a priority (0 first); a detection is dropped
if it lies inside one of an earlier priority, or of the same priority and longer (the
earlier rule on a tie). The rules: for each license family below its identifier line,
grants by name, its name alone, and its addresses; and a few general grants.

The base phrases are matched as consecutive words and always count. score is 0 without
any detection, else 1 minus the product of (1 - weight) over the detections kept and the
base places, where a rule's weight falls with its priority.

Null and empty texts have no words and no detections. Very long texts are scanned whole.
Null doc_ids are kept; repeated rows are scanned each. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SQL_LOWER, SQL_UPPER, map_texts, table

#: Phrases and labels that always count.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label | identifiers | name | address | keywords, any of which the name and address need. Blanks in names stand for any white space.
FAMILIES = r"""
gpl-2.0 | gpl-2\.0(?:-only|-or-later|\+)? | (?:gnu )?(?:general public license|gpl),? (?:version |v\.? ?)2(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0 | gpl,general public
gpl-3.0 | gpl-3\.0(?:-only|-or-later|\+)? | (?:gnu )?(?:general public license|gpl),? (?:version |v\.? ?)3(?:\.0)? | gnu\.org/licenses/gpl-3\.0 | gpl,general public
gpl | gpl(?:-1\.0)?(?:-only|-or-later|\+)? | gnu (?:general public license|gpl) | gnu\.org/(?:copyleft|licenses)/gpl\.(?:html|txt) | gpl,general public
lgpl-2.1 | lgpl-2\.1(?:-only|-or-later|\+)? | (?:gnu )?(?:lesser general public license|lgpl),? (?:version |v\.? ?)2\.1 | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1 | lgpl,lesser
lgpl-3.0 | lgpl-3\.0(?:-only|-or-later|\+)? | (?:gnu )?(?:lesser general public license|lgpl),? (?:version |v\.? ?)3 | gnu\.org/licenses/lgpl-3\.0 | lgpl,lesser
lgpl | lgpl(?:-2\.0)?(?:-only|-or-later|\+)? | gnu (?:lesser|library) general public license | gnu\.org/licenses/lgpl | lgpl,lesser,library
agpl-3.0 | agpl-3\.0(?:-only|-or-later|\+)? | (?:gnu )?(?:affero general public license|agpl),? (?:version |v\.? ?)3 | gnu\.org/licenses/agpl-3\.0 | agpl,affero
agpl | agpl(?:-1\.0)? | gnu affero general public license | gnu\.org/licenses/agpl | agpl,affero
gfdl | gfdl-1\.[123](?:-only|-or-later)? | gnu free documentation license | gnu\.org/licenses/fdl | gfdl,fdl,free documentation
apache-2.0 | apache-2\.0 | apache (?:software )?license,? (?:version |v\.? ?)2(?:\.0)? | apache\.org/licenses/license-2\.0 | apache
apache-1.1 | apache-1\.1 | apache (?:software )?license,? (?:version |v\.? ?)1\.1 | apache\.org/licenses/license-1\.1 | apache
apache | apache(?:-1\.0)? | apache (?:software )?license | apache\.org/licenses | apache
mit | mit | (?:the )?mit license | opensource\.org/licenses?/mit | mit
mit-0 | mit-0 | mit no attribution(?: license)? | opensource\.org/licenses?/mit-0 | mit
x11 | x11 | x11 license | opensource\.org/licenses?/x11 | x11
expat | expat | expat license | jclark\.com/xml/copying | expat,jclark
bsd-2-clause | bsd-2-clause | (?:simplified|2-clause|two-clause|freebsd) bsd license | opensource\.org/licenses?/bsd-2-clause | bsd
bsd-3-clause | bsd-3-clause | (?:new|revised|modified|3-clause|three-clause) bsd license | opensource\.org/licenses?/bsd-3-clause | bsd
bsd-4-clause | bsd-4-clause | (?:original|4-clause|four-clause) bsd license | spdx\.org/licenses/bsd-4-clause | bsd
bsd-0-clause | 0bsd | (?:zero-clause|0-clause|free public) (?:bsd )?license | opensource\.org/licenses?/0bsd | bsd,free public,zero-clause,0-clause
bsd | bsd | bsd(?:-style)? license | opensource\.org/licenses?/bsd-license | bsd
isc | isc | isc license | opensource\.org/licenses?/isc | isc
mpl-1.1 | mpl-1\.1 | mozilla public license,? (?:version |v\.? ?)1\.1 | mozilla\.org/mpl/mpl-1\.1 | mpl,mozilla
mpl-2.0 | mpl-2\.0 | mozilla public license,? (?:version |v\.? ?)2(?:\.0)? | mozilla\.org/(?:mpl|en-us/mpl)/2\.0 | mpl,mozilla
mpl | mpl(?:-1\.0)? | mozilla public license | mozilla\.org/mpl | mpl,mozilla
epl-1.0 | epl-1\.0 | eclipse public license,? (?:- )?(?:version |v\.? ?)1(?:\.0)? | eclipse\.org/legal/epl-v10 | epl,eclipse
epl-2.0 | epl-2\.0 | eclipse public license,? (?:- )?(?:version |v\.? ?)2(?:\.0)? | eclipse\.org/legal/epl-2\.0 | epl,eclipse
epl | epl | eclipse public license | eclipse\.org/legal/epl | epl,eclipse
edl | edl-1\.0 | eclipse distribution license | eclipse\.org/org/documents/edl | edl,eclipse
cddl-1.0 | cddl-1\.0 | common development and distribution license,? (?:version |v\.? ?)1\.0 | opensource\.org/licenses?/cddl-1\.0 | cddl,common development
cddl | cddl(?:-1\.1)? | common development and distribution license | opensource\.org/licenses?/cddl | cddl,common development
cpl | cpl-1\.0 | common public license | opensource\.org/licenses?/cpl | cpl,common public
eupl-1.2 | eupl-1\.2 | european union public licen[cs]e,? (?:version |v\.? ?)1\.2 | joinup\.ec\.europa\.eu/[a-z/]*eupl | eupl,european union
eupl | eupl(?:-1\.[01])? | european union public licen[cs]e | eupl\.eu | eupl,european union
osl | osl-[123]\.[01] | open software license | opensource\.org/licenses?/osl | osl,open software
afl | afl-[123]\.[0-2] | academic free license | opensource\.org/licenses?/afl | afl,academic free
artistic-2.0 | artistic-2\.0 | artistic license,? (?:version )?2\.0 | opensource\.org/licenses?/artistic-2\.0 | artistic
artistic | artistic-1\.0 | (?:perl )?artistic license | opensource\.org/licenses?/artistic | artistic
zlib | zlib | zlib(?:/libpng)? license | zlib\.net/zlib_license | zlib
libpng | libpng(?:-2\.0)? | libpng license | libpng\.org/pub/png/src/libpng-license | libpng
boost | bsl-1\.0 | boost software license | boost\.org/license_1_0 | bsl,boost
unlicense | unlicense | the unlicense | unlicense\.org | unlicense
wtfpl | wtfpl | do what the fuck you want to public license | wtfpl\.net | wtfpl,want to public
cc0 | cc0-1\.0 | (?:creative commons zero|cc0)(?: 1\.0)?(?: universal)? | creativecommons\.org/publicdomain/zero | cc0,creative commons,creativecommons
cc-by-sa | cc-by-sa-[1-4]\.[05] | (?:creative commons attribution[- ]share ?alike|cc[- ]by[- ]sa) | creativecommons\.org/licenses/by-sa | cc,creative commons
cc-by-nc-sa | cc-by-nc-sa-[1-4]\.[05] | (?:creative commons attribution[- ]non-?commercial[- ]share ?alike|cc[- ]by[- ]nc[- ]sa) | creativecommons\.org/licenses/by-nc-sa | cc,creative commons
cc-by-nc-nd | cc-by-nc-nd-[1-4]\.[05] | (?:creative commons attribution[- ]non-?commercial[- ]no ?deriv(?:ative|s|atives)?|cc[- ]by[- ]nc[- ]nd) | creativecommons\.org/licenses/by-nc-nd | cc,creative commons
cc-by-nc | cc-by-nc-[1-4]\.[05] | (?:creative commons attribution[- ]non-?commercial|cc[- ]by[- ]nc) | creativecommons\.org/licenses/by-nc/ | cc,creative commons
cc-by-nd | cc-by-nd-[1-4]\.[05] | (?:creative commons attribution[- ]no ?deriv(?:ative|s|atives)?|cc[- ]by[- ]nd) | creativecommons\.org/licenses/by-nd | cc,creative commons
cc-by | cc-by-[1-4]\.[05] | (?:creative commons attribution|cc[- ]by)(?: license| [1-4]\.0) | creativecommons\.org/licenses/by/ | cc,creative commons
public-domain | public-domain | (?:dedicated to|placed in|released into) the public domain | creativecommons\.org/publicdomain/mark | public domain,publicdomain
odbl | odbl-1\.0 | open (?:data commons open )?database license | opendatacommons\.org/licenses/odbl | odbl,database license
odc-by | odc-by-1\.0 | open data commons attribution license | opendatacommons\.org/licenses/by | odc,data commons
pddl | pddl-1\.0 | public domain dedication and license | opendatacommons\.org/licenses/pddl | pddl,dedication
ofl | ofl-1\.[01] | (?:sil )?open font license | scripts\.sil\.org/ofl | ofl,open font
python | psf-2\.0 | (?:python software foundation|psf) license | docs\.python\.org/[0-9/]*license | psf,python
ruby | ruby | ruby license | ruby-lang\.org/en/license | ruby
php | php-3\.0[01]? | php license | php\.net/license | php
postgresql | postgresql | postgresql licen[cs]e | postgresql\.org/about/licence | postgresql
openssl | openssl | openssl license | openssl\.org/source/license | openssl
w3c | w3c | w3c (?:software (?:notice and )?)?license | w3\.org/consortium/legal | w3c,w3\.org
ncsa | ncsa | university of illinois/?ncsa open source license | opensource\.org/licenses?/ncsa | ncsa
vim | vim | vim license | vimhelp\.org/uganda | vim
icu | icu | icu license | icu-project\.org/repos/icu | icu
unicode | unicode-dfs-201[56] | unicode(?:, inc\.)? license agreement | unicode\.org/(?:license|copyright) | unicode
ms-pl | ms-pl | microsoft public license | opensource\.org/licenses?/ms-pl | ms-pl,microsoft
ms-rl | ms-rl | microsoft reciprocal license | opensource\.org/licenses?/ms-rl | ms-rl,microsoft
bsl-1.1 | busl-1\.1 | business source license(?: 1\.1)? | mariadb\.com/bsl11 | busl,business source,bsl11
sspl | sspl-1\.0 | server side public license | mongodb\.com/licensing/server-side-public-license | sspl,server side,server-side
elastic-2.0 | elastic-2\.0 | elastic license(?: 2\.0)? | elastic\.co/licensing/elastic-license | elastic
"""

#: label | priority | keyword | pattern
GENERAL = r"""
mit | 1 | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy
isc | 1 | permission to use, copy | permission to use, copy, modify,? and(?:/or)? distribute this software
bsd | 1 | redistribution and use | redistribution and use in source and binary forms
gpl | 1 | free software | this (?:program|library) is free software[:;,] you can redistribute it
all-rights-reserved | 4 | all rights reserved | all rights reserved
proprietary | 3 | proprietary | proprietary and confidential
see-license | 4 | license | see (?:the )?license(?:\.txt|\.md)? (?:file )?for (?:more )?details
"""
WEIGHTS = (0.99, 0.95, 0.85, 0.7, 0.4)
BASE_WEIGHT = 0.8
SPACE = rb"[ \t\n\r*#/;-]"
#: Bytes that are no part of a word become blanks.
BLANKS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]


def _pattern(x: str) -> re.Pattern[bytes]:
    b = x.encode().replace(b"[- ]", b" ").replace(b" ?", b"\0").replace(b" ", SPACE + b"+").replace(b"\0", SPACE + b"*")
    return re.compile(rb"(?<![0-9a-z_])(?:" + b + rb")(?![0-9a-z_])")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    out = []
    for line in FAMILIES.strip().splitlines():
        label, spdx, name, address, keys = (x.strip() for x in line.split(" | "))
        keys = tuple(x.replace("\\", "").encode() for x in keys.split(","))
        hosts = (re.split(r"[(/?\[]", address)[0].replace("\\", "").encode(),)
        out += [
            Rule(label, 0, (b"spdx",), _pattern(rf"spdx-license-identifier: \(?{spdx}")),
            Rule(label, 1, keys, _pattern(rf"(?:licensed|released|distributed|available|published|redistributed|used) (?:and/or modified )?under (?:the )?(?:terms of )?(?:the )?{name}")),
            Rule(label, 2, keys, _pattern(name)),
            Rule(label, 2, hosts, _pattern(address)),
            Rule(label, 3, (b"licen",), _pattern(rf"licen[cs]e: ?[\"']?{spdx}")),
        ]
    for line in GENERAL.strip().splitlines():
        label, priority, key, x = (y.strip() for y in line.split(" | "))
        out.append(Rule(label, int(priority), (key.encode(),), _pattern(x)))
    return tuple(out)


def detections(low: bytes) -> list[tuple[str, int, int, int]]:
    """(label, priority, start, end) of what the rules find in a lower-cased text, containment resolved."""
    has: dict[bytes, bool] = {}
    found = []
    for order, r in enumerate(rules()):
        for k in r.keywords:
            if k not in has:
                # Word by word: any run of SPACE may stand for a blank.
                has[k] = all(w in low for w in k.split())
        if any(map(has.__getitem__, r.keywords)):
            found += [(r.priority, m.start() - m.end(), order, m.start(), m.end(), r.label) for m in r.pattern.finditer(low)]
    return uncontained(found)


def uncontained(found: list[tuple[int, int, int, int, int, str]]) -> list[tuple[str, int, int, int]]:
    """(label, priority, start, end) of detections (priority, -length, rule, start, end, label) that lie in none before them in this order.

    The furthest end of those kept, up to a start, is the maximum of a prefix: a tree over the starts gives it in the logarithm of their number.
    """
    place = {a: i for i, a in enumerate(sorted({x[3] for x in found}), 1)}
    furthest = [0] * (len(place) + 1)
    kept = []
    for priority, _, _, a, b, label in sorted(found):
        i = at = place[a]
        end = 0
        while i:
            end = max(end, furthest[i])
            i &= i - 1
        if end >= b:
            continue
        kept.append((label, priority, a, b))
        while at < len(furthest):
            furthest[at] = max(furthest[at], b)
            at += at & -at
    return kept


#: Single words, as blanks may be any run of SPACE. A text without any of these has neither a base phrase nor a detection.
GATE = re.compile(rb"licen[cs]e|copyright|spdx|cc|domain|permission|redistribut|gpl|bsd|mit|apache|proprietary|reserved|\.org|\.net|\.com|\.eu|\.co/|commons|cc0")


def scan(text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, int]]]:
    """Words; (word index, label) of base places; rule detections."""
    low = text.lower()
    words = low.translate(BLANKS).split()
    if not GATE.search(low):
        return len(words), [], []
    base = []
    for phrase, label in BASE.items():
        p = phrase.encode().split()
        at = -1
        try:
            while True:
                at = words.index(p[0], at + 1)
                if words[at : at + len(p)] == p:
                    base.append((at, label))
        except ValueError:
            pass
    return len(words), sorted(base), detections(low)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places (word, label), and detections (label, priority, start, end in bytes of UTF-8) of docs(doc_id, text)."""

    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    hit = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(ids, texts):
        out = [scan(x) for x in texts]
        base = [[{"word": w, "label": x} for w, x in y] for _, y, _ in out]
        found = [[{"label": x, "priority": p, "start": a, "end": b} for x, p, a, b in y] for _, _, y in out]
        return pa.array(ids, pa.int64()), [n for n, _, _ in out], pa.array(base, place), pa.array(found, hit)

    return map_texts(docs, rows, "doc_id long, n_words long, base array<struct<word:long,label:string>>, found array<struct<label:string,priority:int,start:long,end:long>>", binary=True)


def license_digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns, from license_scan()."""
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    miss = F.aggregate("found", F.pow(F.lit(1 - BASE_WEIGHT), F.size("base").cast("double")), lambda acc, x: acc * (1 - F.element_at(F.array(*map(F.lit, WEIGHTS)), x["priority"] + 1)))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat(F.col("base.label"), F.col("found.label"))).alias("labels"),
        (1 - miss).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(license_scan(table(spark, sf_dir, "documents")))


def license_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express: words and base places, from the same operator."""
    return op5_license_scan(spark, sf_dir).drop("labels", "score")


def _base_oracle() -> str:
    is_at = lambda p: " AND ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
    found = " UNION ALL ".join(f"SELECT r, unnest(list_filter(range(1, len(ws) + 1), lambda i: coalesce({is_at(p)}, false))) - 1 AS pos, '{label}' AS label FROM w" for p, label in BASE.items())
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{SQL_UPPER}', '{SQL_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), found AS ({found}),
each AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels
FROM w LEFT JOIN each USING (r)"""


#: DuckDB SQL for license_base_columns.
BASE_ORACLE = _base_oracle()
