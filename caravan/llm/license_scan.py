"""Licence scan by canonical digests: texts are normalised, hashed, and joined with the digests of known licence texts."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.llm.shared import materialize, small

#: Spellings that count as equal, as in the public guidelines for matching licence texts.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("cancelled", "canceled"), ("catalogue", "catalog"),
    ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"),
    ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
]
#: What the SQL takes for a copyright line. It takes lines of a licence's body that a wrapping begins with the word as well, so
#: the operator has its own: a mark or a year must follow, or a holder in the first two lines of a text.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*$"
_MARK, _YEAR = r"(?:\(c\)|©)", r"(?:[^a-z0-9\n]*(?:19|20)\d\d|[ \t]*[<\[{])"
NOTICE_LINE = rf"(?m)^[^a-z0-9\n]*(?:copyright[^a-z0-9\n(©]*{_MARK}|(?:{_MARK}[^a-z0-9\n]*)?copyright{_YEAR}|{_MARK}{_YEAR})[^\n]*$"
HOLDER_LINE = rf"\A(\s*(?:[^\n]{{1,80}}\n\s*)?)[^a-z0-9\n]*(?:copyright(?![a-z0-9])|{_MARK})(?![^a-z\n]*(?:holders?|notices?|owners?|laws?|licen[cs]es?)\b)[^\n]{{1,80}}(?=\n)"
#: Java's and RE2's syntax alike.
SEPARATORS = r"[^\p{L}\p{N}\n]+"
BLANKS = r"[ \n]+"

#: Licences and how their names are written.
NAMES = [
    ("Apache-2.0", "Apache License, Version 2.0"), ("MIT", "MIT License"), ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"),
    ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
]
NOTICES = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}"]
#: Texts of short licences.
TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""),
]


#: Texts that the SQL does not know. BSD names its clauses' numbers and its speakers in several ways, see _spellings().
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
MORE_TEXTS = [("BSD-2-Clause", _BSD.format("")), ("BSD-3-Clause", _BSD.format(_BSD_3))]
#: Lines that may stand above a short licence.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License"],
}
#: Who provides the software and who is not liable, in BSD texts.
SPEAKERS = [
    ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"), ("COPYRIGHT HOLDERS", "COPYRIGHT OWNER"),
    ("AUTHOR", "AUTHOR"), ("AUTHORS", "AUTHORS"), ("AUTHOR", "AUTHORS"), ("REGENTS", "REGENTS"),
]
#: Long licences, word for word; {name}.txt in this folder. Where their terms end, an appendix on how to use them may be left off.
LONG = Path(__file__).parent / "license_texts"
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def _spellings(licence: str, text: str) -> list[str]:
    """Ways to write a short licence's body."""
    if not licence.startswith("BSD"):
        return [text]
    out = []
    for provided, liable in SPEAKERS:
        said = text.replace("COPYRIGHT HOLDERS AND", f"{provided} AND").replace("COPYRIGHT HOLDER OR", f"{liable} OR")
        out += [said, re.sub(r"(?m)^\d\. ", "", said)]
    return out


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text): short licences with and without a title and the line on reserved rights, and long ones."""
    out = []
    for licence, text in [*TEXTS, *MORE_TEXTS]:
        heads = [f"{title}\n{rights}" for title in ["", *TITLES[licence]] for rights in ("", "All rights reserved.\n")]
        out += [(licence, head + body) for body in _spellings(licence, text) for head in heads]
    for path in sorted(LONG.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, text))
        if END_OF_TERMS in text:
            terms = text[: text.index(END_OF_TERMS)]
            out += [(path.stem, terms), (path.stem, terms + END_OF_TERMS)]
    return out


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): the texts that the SQL knows, and every notice with every name."""
    return [*TEXTS, *((licence, notice.format(name) + ".") for licence, name in NAMES for notice in NOTICES)]


def normal_lines(text: Column) -> Column:
    """Lower case, no copyright notices, two blanks for whatever is no letter or digit, one spelling; line ends stay."""
    lines = F.regexp_replace(F.regexp_replace(F.lower(text), HOLDER_LINE, "$1"), NOTICE_LINE, "")
    padded = F.replace(F.concat(F.lit("  "), F.regexp_replace(lines, SEPARATORS, "  "), F.lit("  ")), F.lit("\n"), F.lit("  \n  "))
    for old, new in EQUIVALENT:
        padded = F.replace(padded, F.lit(_padded(old)), F.lit(_padded(new)))
    return padded


def squeeze(lines: Column) -> Column:
    """One blank between words."""
    return F.trim(F.regexp_replace(lines, BLANKS, " "))


def canonical(text: Column) -> Column:
    return squeeze(normal_lines(text))


def _padded(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def registry(spark: SparkSession, texts: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(digest, license, n_chars): texts by canonical digest and their canonical length; of licences with one text, the first by name.

    texts(license, text) may be a table of one's own, of any number of licences; the texts of this module stand in for it.
    """
    rows = texts if isinstance(texts, DataFrame) else spark.createDataFrame([*known_texts(), *whole_texts()] if texts is None else texts, "license string, text string")
    known = rows.select("license", canonical(F.col("text")).alias("text")).where("text <> ''")
    return known.select(F.sha2("text", 256).alias("digest"), "license", F.length("text").alias("n_chars")).groupBy("digest", "n_chars").agg(F.min("license").alias("license"))


#: Lengths of known texts up to which lines are chosen by them; by the shortest and the longest beyond.
LENGTHS = 1000


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_digest, license: whose text the whole document is, n_notices, notices: sorted, comma-joined).

    docs(doc_id, text, ...): one row out for each row in. n_notices counts the lines that are a known text by themselves, notices
    names their licences. A null text has a null digest and no licence; a text without letters and digits has the digest of
    the empty text, which is never a licence's. Rows that repeat a doc_id, null too, are documents of their own. known is
    registry()'s kind of table; an empty one finds nothing; so does an empty docs. Texts of any length are normalised whole.

    Texts are normalised once: a step is written with the digest of each text and those of its lines that are as long as a known
    text. The registry is broadcast only if its measured size allows it.
    """
    spark = docs.sparkSession
    known = materialize(registry(spark) if known is None else known, "registry")
    lengths = [x["n_chars"] for x in known.select("n_chars").distinct().orderBy("n_chars").limit(LENGTHS + 1).collect()]
    longest = known.agg(F.max("n_chars").alias("m")).first()["m"]
    may_be = lambda x: F.length(x).isin(lengths) if len(lengths) <= LENGTHS else F.length(x).between(lengths[0], longest)
    size = known.count() * 150
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), normal_lines(F.col("text").cast("string")).alias("lines"))
    single = F.filter(F.transform(F.split("lines", "\n"), squeeze), may_be if lengths else lambda x: F.lit(False))
    coded = materialize(rows.select("row", "doc_id", F.sha2(squeeze(F.col("lines")), 256).alias("text_digest"), F.transform(single, lambda x: F.sha2(x, 256)).alias("lines")), "digests")
    known = known.select("digest", "license")
    found = coded.select("row", F.explode("lines").alias("digest")).join(small(known, size), "digest").groupBy("row").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    whole = coded.join(small(known, size), F.col("text_digest") == F.col("digest"), "left").join(found, "row", "left")
    return whole.select("doc_id", "text_digest", "license", F.coalesce("n", F.lit(0)).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def lines(column: str) -> str:
        out = f"replace('  ' || regexp_replace(regexp_replace(lower({column}), {quoted(COPYRIGHT_LINE)}, '', 'g'), {quoted(SEPARATORS)}, '  ', 'g') || '  ', chr(10), '  ' || chr(10) || '  ')"
        for old, new in EQUIVALENT:
            out = f"replace({out}, {quoted(_padded(old))}, {quoted(_padded(new))})"
        return out

    def squeezed(column: str) -> str:
        return f"trim(regexp_replace({column}, {quoted(BLANKS)}, ' ', 'g'))"

    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known_texts())
    return f"""
        WITH known AS (SELECT sha256({squeezed(lines('t'))}) AS digest, min(l) AS license FROM (VALUES {values}) AS v(l, t) GROUP BY 1),
        rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM {table}),
        lines AS (SELECT r, unnest(string_split({lines('text')}, chr(10))) AS line FROM rows),
        found AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
                  FROM lines JOIN known ON sha256({squeezed('line')}) = digest GROUP BY r),
        whole AS (SELECT r, doc_id, sha256({squeezed(lines('text'))}) AS text_digest FROM rows)
        SELECT doc_id, text_digest, license, coalesce(n, 0) AS n_notices, coalesce(notices, '') AS notices
        FROM whole LEFT JOIN known ON text_digest = digest LEFT JOIN found USING (r)"""
