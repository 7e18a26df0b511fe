"""Licence scans: whole texts against digests of known licences in canonical form; DataFrame operations only."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that count as equal, as words of the canonical form; the right one is kept.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"),
    ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("categorise", "categorize"),
    ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("noncommercial", "non commercial"), ("copyright owner", "copyright holder"), ("https", "http"),
)

# Short public licence texts and notices, by identifier.
LICENSES = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
}


# What goes on with `copyright` in a sentence of a licence.
_PROSE = "holders?|owners?|notices?|laws?|licen[sc]es?|statements?|interests?|and|or|in|is|of|on|to|for|disclaimer|protection|treat(?:y|ies)|rights?|permissions?|infringement|material|status|doctrines|resulting|claimed|covering|protected|applicable|does|may|shall|are|was|were|that|which|with|under|legends?|assignments?|ownership|registrations?|act|terms?|exists?|the[ \\t]+(?:library|software|programs?|works?)"
_SAID = rf"copyright[ \t]*(?:(?:\(c\)|©)[ \t:]*\S|[:\d]|[ \t]+(?!(?:{_PROSE})(?![\p{{L}}\p{{N}}]))\S)[^\r\n]*"
_SIGN = rf"©[ \t:]*\S[^\r\n]*|\(c\)[ \t:]*(?:\d[^\r\n]*|[^\r\n]*(?<!\d)(?:19|20)\d\d(?!\d)[^\r\n]*|\S+(?:[ \t]+\S+){{0,4}}(?:(?<![.;:,])|(?<=[ \t](?:inc|ltd|co)\.))[ \t]*$(?=\r?\n[^\p{{L}}\p{{N}}\n]*(?:\n|all rights|copyright)|\z))"
_RESERVED = r"(?:\s*^[^\p{L}\p{N}\r\n]*all rights reserved[^\p{L}\p{N}\r\n]*$(?=[^\p{L}\p{N}]*[\p{L}\p{N}]))?"
COPYRIGHT = rf"(?m)^[^\p{{L}}\p{{N}}\r\n(©]*(?:{_SAID}|{_SIGN})$?{_RESERVED}"


def shipped() -> list[tuple[str, str]]:
    """(identifier, text) of the whole texts beside this code, also without what follows their terms, and BSD's points without numbers."""
    out = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        terms, mark, _ = text.partition("END OF TERMS AND CONDITIONS")
        forms = [text, terms, terms + mark] if mark else [text]
        forms += [re.sub(r"(?m)^\s*\d\.", "", text)] if name.startswith("BSD-") else []
        forms += [text.split("For more information")[0], text.replace("https:", "http:").replace(".org>", ".org/>")] if name == "Unlicense" else []
        out += [(name, form) for form in forms]
    return out


def canonical(text: Column) -> Column:
    """The words of a text in lower case, one space apart, without lines that only state a copyright and with one spelling.

    A copyright line begins, after marks and blanks, with `copyright`, `(c)` or the sign, and
    a holder or year follows, with or without a blank or colon; a line `All rights reserved` below it
    goes with it if other words follow. Wrapped sentences that go on with `copyright holders` or
    the like, and points (c) of a list, are no copyright lines. Null is empty.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, COPYRIGHT, " ")
    # two blanks between words, so that neighbours do not share one and all of a run are found
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for other, word in SPELLINGS:
        t = F.replace(t, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {word.replace(' ', '  ')} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def known_licenses(spark: SparkSession, texts: Mapping[str, str] | None = None) -> DataFrame:
    """(digest, license): the SHA-256 of each canonical text, by default LICENSES and those shipped; of equal ones the first identifier by name."""
    texts = sorted([*LICENSES.items(), *shipped()] if texts is None else texts.items())
    rows = spark.createDataFrame(texts, T.StructType([T.StructField("license", T.StringType()), T.StructField("text", T.StringType())]))
    rows = rows.select("license", F.sha2(F.encode(canonical(F.col("text")), "utf-8"), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 100_000) -> DataFrame:
    """One row per input row: id, license (null if the whole text is none that is known), digest.

    Digests of whole canonical texts are joined by hash. The licences are broadcast
    only after counting that they are at most `most_broadcast`; more of them are shuffled.

    Null and empty texts, and texts of marks or copyright lines alone, have the digest of the
    empty text, which matches no licence. Ids may be null or repeat; an empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("i"), canonical(F.col(text_col)).alias("t"))
    rows = rows.select("i", F.sha2(F.encode("t", "utf-8"), 256).alias("d"), (F.col("t") == "").alias("none"))
    side = licenses.select(F.col("digest").alias("ld"), "license")
    if side.limit(most_broadcast + 1).count() <= most_broadcast:
        side = F.broadcast(side)
    found = rows.join(side, (F.col("d") == F.col("ld")) & ~F.col("none"), "left")
    return found.select(F.col("i").alias(id_col), "license", F.col("d").alias("digest"))
