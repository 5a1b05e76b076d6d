"""Licence scan by canonical digests, in Spark SQL only: whole texts, their paragraphs and their lines are normalised and
hash-joined, each as an entire text, to the digests of known licences and licence notices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, table

# The wording of public licence texts and notices.
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_ISC_WARRANTY = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_THIRD = "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_TAIL = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
_ISC_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
TEXTS = {
    "MIT": [f"{_MIT_GRANT} {_WARRANTY}", f"MIT License {_MIT_GRANT} {_WARRANTY}", f"The MIT License (MIT) {_MIT_GRANT} {_WARRANTY}"],
    "ISC": [f"{_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies {_ISC_WARRANTY}", f"ISC License {_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies {_ISC_WARRANTY}"],
    "0BSD": [f"{_ISC_GRANT} {_ISC_WARRANTY}"],
    "BSD-2-Clause": [f"{_BSD_HEAD} {_BSD_TAIL}", f"BSD 2-Clause License {_BSD_HEAD} {_BSD_TAIL}"],
    "BSD-3-Clause": [f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}", f"BSD 3-Clause License {_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"],
    "Apache-2.0": ["licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"],
}
#: Names by which notices of one line speak of a licence.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Revised BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    **{f"{a}GPL-{v}": [f"GNU {n} Public License, Version {v}", f"GNU {n} Public License {v}", f"GNU {a}GPL v{v.split('.')[0]}"] for a, n, vs in (("", "General", ("2.0", "3.0")), ("L", "Lesser General", ("2.1", "3.0")), ("A", "Affero General", ("3.0",))) for v in vs},
    **{f"{a}GPL-{v}.0": [f"GNU {n} Public License, Version {v}"] for a, n, vs in (("", "General", (2, 3)), ("L", "Lesser General", (3,)), ("A", "Affero General", (3,))) for v in vs},
    **{f"CC-{k.upper()}-{v}": [f"CC {k.upper()} {v}", f"CC-{k.upper()}-{v}", f"Creative Commons {k.upper()} {v}"] for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("3.0", "4.0")},
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "Unlicense": ["Unlicense"],
}
#: The lines above on one GNU version leave those of the same key out; these are all.
MORE_NAMES = {f"{a}GPL-{v}": [f"GNU {n} Public License, Version {v}", f"GNU {n} Public License {v}", f"GNU {a}GPL v{v.split('.')[0]}"] for a, n, vs in (("", "General", ("2.0", "3.0")), ("L", "Lesser General", ("2.1", "3.0")), ("A", "Affero General", ("3.0",))) for v in vs}
# SHA-256 of the canonical form of whole licence texts as their publishers give them.
BODIES = {
    "Apache-2.0": ["04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"],
    "Artistic-1.0-Perl": ["e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"],
    "BSD-3-Clause": ["21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"],
    "CC0-1.0": ["cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"],
    "GFDL-1.2": ["5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"],
    "GFDL-1.3": ["93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"],
    "GPL-1.0": ["8c8ccb91609d86476ba694f3852da0b81e4187521eb7027193a50e4de976832f"],
    "GPL-2.0": ["4508df86bd15812610aac1b41e1fd910e35fac55f8992f4c69b7403e76080a32"],
    "GPL-3.0": ["a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"],
    "LGPL-2.0": ["a3a53d306db00bff75c36418b878c0c726e136a456022befcf732ae5fadfeb89"],
    "LGPL-2.1": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"],
    "MPL-2.0": ["6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"],
}
NOTICES = ("Released under the {}", "Released under {}", "Licensed under the {}", "Licensed under {}", "This work is licensed under the {}", "This work is licensed under {}", "This project is licensed under the {}", "Distributed under the {}", "This software is released under the {}", "Available under the {}", "SPDX-License-Identifier: {}")
#: Spellings that count as one, applied to words with single spaces between.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("free software foundation s", "free software foundation"))
_COPYRIGHT = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|<|\[|[0-9]{4})[^\n]*"
_RIGHTS = r"(^|\n)[ \t#*/;-]*all rights reserved[.]?[ \t]*"
_BETWEEN = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
_PARAGRAPH = r"\n[ \t\r]*\n"
#: Every known text has one of these words, whatever stands between its words, so a text without them can match none.
MARKERS = ("licen", "permission", "redistribution", "released", "distributed", "available")


def known(names_by_licence: tuple[dict, ...] = (NAMES, MORE_NAMES)) -> list[tuple[str, str]]:
    """(licence, wording) of every text and of every notice with every name, some hundred rows whatever the corpus."""
    rows = [(k, t) for k, texts in TEXTS.items() for t in texts]
    for k, names in (item for own in names_by_licence for item in own.items()):
        rows += [(k, n.format(name)) for name in (*names, k) for n in NOTICES]
    return sorted(set(rows))


def canonical(text: Column) -> Column:
    """Lower case; copyright lines out; what stands between words becomes one space; equivalent spellings become one."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT, "$1"), _RIGHTS, "$1")
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, F.trim(F.regexp_replace(low, _BETWEEN, " ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, licence): of the wordings above and of the whole licence bodies; a wording that several licences share goes to the
    first by name."""
    wordings = spark.createDataFrame(known(), "licence string, wording string").select("licence", digest(F.col("wording")).alias("digest"))
    bodies = spark.createDataFrame([(k, d) for k, own in BODIES.items() for d in own], "licence string, digest string")
    return wordings.unionByName(bodies).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, whole_licence, n_paragraphs, n_lines, licences) per input row: the licence that the whole text is, the numbers of
    paragraphs and lines that are one, and the distinct licences found, sorted and comma-joined.

    Null, empty and marker-free texts match nothing (null, 0, 0, ''); repeated rows and texts are looked up once and each have the
    result; a very long text is one whole text, its paragraphs and its lines; an empty table gives no rows; other columns are
    ignored."""
    own = id_and_text(docs, id_col, text_col)
    low = F.lower("text")
    marked = reduce(lambda a, b: a | b, [low.contains(m) for m in MARKERS])
    candidates = own.where(marked).withColumn("key", F.md5(F.col("text").cast("binary")))
    has_marker = lambda u: reduce(lambda a, b: a | b, [F.lower(u).contains(m) for m in MARKERS])
    unit = lambda kind, parts: F.transform(F.filter(parts, has_marker), lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("unit")))
    units = F.concat(unit("whole", F.array("text")), unit("paragraph", F.split("text", _PARAGRAPH, -1)), unit("line", F.split("text", "\n", -1)))
    exploded = candidates.dropDuplicates(["key"]).select("key", F.explode(units).alias("u")).select("key", "u.kind", digest(F.col("u.unit")).alias("digest"))
    found = exploded.join(F.broadcast(known_digests(docs.sparkSession)), "digest")
    of = lambda kind: F.when(F.col("kind") == kind, 1)
    per_text = found.groupBy("key").agg(F.max(F.when(F.col("kind") == "whole", F.col("licence"))).alias("whole_licence"), F.count(of("paragraph")).alias("n_paragraphs"), F.count(of("line")).alias("n_lines"), F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("licences"))
    hit = candidates.select("doc_id", "key").join(per_text, "key", "left").select("doc_id", "whole_licence", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("licences", F.lit("")).alias("licences"))
    none = own.where(~marked).select("doc_id", F.lit(None).cast("string").alias("whole_licence"), F.lit(0).cast("long").alias("n_paragraphs"), F.lit(0).cast("long").alias("n_lines"), F.lit("").alias("licences"))
    return none.unionByName(hit)


def op5_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    low = f"regexp_replace(regexp_replace(lower({x}), {q(_COPYRIGHT)}, '\\1', 'g'), {q(_RIGHTS)}, '\\1', 'g')"
    out = f"trim(regexp_replace({low}, {q(_BETWEEN)}, ' ', 'g'))"
    for a, b in SPELLINGS:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


def oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(k)}, {q(t)})" for k, t in known())
    bodies = ", ".join(f"({q(k)}, {q(d)})" for k, own in BODIES.items() for d in own)
    marked = lambda x: "(" + " OR ".join(f"contains(lower({x}), {q(m)})" for m in MARKERS) + ")"
    return f"""
WITH known AS (SELECT digest, min(licence) AS licence FROM (SELECT sha256({_sql_canonical("wording")}) AS digest, licence FROM (VALUES {values}) AS t(licence, wording)
  UNION ALL SELECT digest, licence FROM (VALUES {bodies}) AS b(licence, digest)) k GROUP BY 1),
own AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT row_id, 'whole' AS kind, text AS unit FROM own
  UNION ALL SELECT row_id, 'paragraph', unnest(regexp_split_to_array(text, {q(_PARAGRAPH)})) FROM own WHERE {marked("text")}
  UNION ALL SELECT row_id, 'line', unnest(string_split(text, chr(10))) FROM own WHERE {marked("text")}),
found AS (SELECT row_id, kind, licence FROM (SELECT row_id, kind, sha256({_sql_canonical("unit")}) AS digest FROM units WHERE {marked("unit")}) JOIN known USING (digest))
SELECT doc_id, max(CASE WHEN kind = 'whole' THEN licence END) AS whole_licence, count(CASE WHEN kind = 'paragraph' THEN 1 END) AS n_paragraphs,
  count(CASE WHEN kind = 'line' THEN 1 END) AS n_lines, coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence), '') AS licences
FROM own LEFT JOIN found USING (row_id) GROUP BY row_id, doc_id"""
