"""Licence scans by canonical digests: texts, and their lines, looked up among known licences.

Whole texts are looked up without what differs from one copy to the next: a title line, "all rights reserved", list
marks and the holder's name in the BSD clauses. Standard headers are wrapped and stand in comments, so they are looked
for in the canonical text as a whole.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: Public licence texts and the notices by which works refer to a licence.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
)
#: Whole public texts, each file named by its licence; where terms end before an appendix, the terms alone are known too.
TEXTS = tuple((re.sub(r"(?:\.variant)?\.txt$", "", p.name), p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
END = "END OF TERMS AND CONDITIONS"
#: Sentences of the standard headers.
_GNU = (("GPL", "GNU General Public License", ("1", "2", "3")), ("LGPL", "GNU Library General Public License", ("2",)), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",)))
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-1.1", 'are subject to the Mozilla Public License Version 1.1 (the "License")'),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"),
    ("EUPL-1.2", "Licensed under the EUPL v. 1.2"),
    *((f"{k}-{v}" if "." in v else f"{k}-{v}.0", f"under the terms of the {name} as published by the Free Software Foundation{by} version {v} of the License") for k, name, versions in _GNU for v in versions for by in ("; either", ";")),
)
#: Spellings that count as one.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("&", " and "), ("http:", "https:"), ("merchantibility", "merchantability"))
COPYRIGHT = r"(?m)^[ \t]*(?:copyright|©|\(c\))[^\n]*$"
OTHER = r"[^\p{L}\p{Nd}]+"
#: Lines that copies of one text differ in. A title is a first line that names a licence and does not refer to one.
RIGHTS = r"(?m)^[ \t]*all rights reserved[. \t]*$"
MARKS = r"(?m)^[ \t]*(?:\(?[0-9a-z][.)]|[*•-])[ \t]+"
TITLE = r"^[^\p{L}]*+(?![^\n]*\bunder\b)[^\n]{0,60}\blicen[sc]e\b[^\n]{0,40}\n"
HOLDERS = (
    (r"neither the names? .{1,100}? nor the names of (?:its|their|the|any) contributors", "neither name nor contributors"),
    (r"is provided by .{1,80}? as is", "is provided as is"),
    (r"in no event shall .{1,100}? be liable", "in no event liable"),
)
#: Texts shorter than this without their title keep it: they are notices.
LEAST = 100


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, spellings made equal, letters and digits only, single blanks."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, OTHER, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def body_digest(text: Column) -> Column:
    """Digest of a text without title, rights line, list marks and holders."""

    def of(t: Column) -> Column:
        rest = canonical(F.regexp_replace(t, TITLE, ""))
        body = let(rest, lambda r: F.when(F.length(r) >= LEAST, r).otherwise(canonical(t)))
        for pattern, to in HOLDERS:
            body = F.regexp_replace(body, pattern, to)
        return F.sha2(body.cast("binary"), 256)

    lines = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, ""), RIGHTS, "")
    return let(F.regexp_replace(lines, MARKS, ""), of)


def _all_known(known) -> list[tuple[str, str]]:
    """The known texts and, for those with an appendix, their terms with and without the closing line."""
    out = list(known)
    for k, t in known:
        if END in t:
            out += [(k, t[: t.index(END)]), (k, t[: t.index(END) + len(END)])]
    return out


def known_digests(spark: SparkSession, known=KNOWN, of=digest) -> DataFrame:
    """(digest, license_id) of the known texts; as many rows as texts are listed."""
    return spark.createDataFrame(_all_known(known), "license_id string, text string").groupBy(of(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=KNOWN + TEXTS, headers=HEADERS) -> DataFrame:
    """One row per row of docs: id, license_id of the whole text or null, notices (licences that single lines or standard headers name, sorted), text_digest.

    Texts without letters or digits (null, empty, punctuation) have no licence. Repeated rows get the same result each;
    other columns of docs are ignored. The list of known texts is the only thing that is broadcast.
    """
    spark = docs.sparkSession
    table = known_digests(spark, known, body_digest)
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_digest = known_digests(spark, known).agg(F.map_from_entries(F.collect_list(F.struct("digest", "license_id"))).alias("_known"))
    # a run of known words, never a part of one
    named = lambda c: F.array_compact(F.array(*[F.when(F.contains(F.concat(F.lit(" "), c, F.lit(" ")), F.concat(F.lit(" "), canonical(F.lit(t)), F.lit(" "))), F.lit(k)) for k, t in headers]))
    none = F.array().cast("array<string>")

    def of(c: Column) -> Column:
        return F.struct(F.when(c != "", F.sha2(c.cast("binary"), 256)).alias("text_digest"), F.when(c != "", body_digest(text)).alias("_body"), F.when(c.rlike("licen[sc]e"), named(c)).otherwise(none).alias("_headers"))

    rows = docs.select(F.col(id_col), text.alias("_t"), let(canonical(text), of).alias("_p")).select(id_col, "_t", "_p.*")
    whole = rows.join(F.broadcast(table), F.col("_body") == F.col("digest"), "left").join(F.broadcast(by_digest), how="left")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"(?i)licen[sc]"))
    notices = F.filter(F.transform(lines, lambda x: F.try_element_at("_known", digest(x))), lambda x: x.isNotNull())
    return whole.select(id_col, "license_id", F.array_join(F.array_sort(F.array_distinct(F.concat(notices, "_headers"))), ",").alias("notices"), "text_digest")
