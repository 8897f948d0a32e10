"""Licence scans by canonical digests: texts are normalised, and whole ones looked up among known licences.

Normalising, in this order: ASCII capitals to lower case; copyright notices at a
line's start go, up to its end or to where a licence begins on it; equivalent spellings become one; everything but letters and digits
becomes a space, and runs of spaces one.  What is left is digested (SHA-256) and
hash-joined to the digests of the known licences.
"""

from __future__ import annotations

import hashlib
import re
import string
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words that a licence begins with after a notice, and words that follow "copyright" in prose.
_BEGINNINGS = ("permission", "redistribution", "redistributions", "licensed", "licenced", "released", "this", "everyone")
_PROSE = (
    "holder", "holders", "owner", "owners", "ownership", "notice", "notices", "law", "laws", "license", "licenses", "licence", "licences", "disclaimer", "disclaimers", "permission", "interest",
    "interests", "treaty", "treaties", "statement", "statements", "patent", "patents", "trademark", "trademarks", "doctrines", "protection", "infringement", "information", "act", "term", "terms",
    "and", "or", "on", "of", "in", "is", "are", "if", "it", "to", "as", "for", "that", "this", "which", "with", "the",
)


def _other_word(words: tuple) -> str:
    """Pattern of a stretch without blanks whose leading letters aren't one of ``words`` (the engines share no negative look-ahead)."""

    def rest(left: list[str], first: bool) -> str:
        heads = sorted({w[0] for w in left if w})
        others = "".join(c for c in string.ascii_lowercase if c not in heads)
        ways = [f"[{others}][a-z]*"] * bool(others) + [c + rest([w[1:] for w in left if w and w[0] == c], False) for c in heads]
        return "(?:" + "|".join(ways + [""] * (not first and "" not in left)) + ")"

    return rf"(?:{rest(list(words), True)}(?:[^a-z \t\r\n][^ \t\r\n]*)?|[^a-z \t\r\n][^ \t\r\n]*)(?:[ \t\r]+|$)"


_YEAR = r"(?:[0-9]{4}|[\[<{])"
#: A notice: copyright with a sign, a year, a place for one or a holder; a sign with a year; or rights reserved; and up to 40 words more.
COPYRIGHT_LINE = (
    r"(?m)^[^a-z0-9\n]*(?:(?:copyright[ \t:,]*(?:\(c\)|\x{a9}|" + _YEAR + r")|\(c\)[ \t]*(?:copyright|" + _YEAR + r")|\x{a9}|all rights reserved)[^ \t\r\n]*(?:[ \t\r]+|$)"
    r"|copyright[ \t:,]+" + _other_word(_PROSE) + ")(?:" + _other_word(_BEGINNINGS) + "){0,40}"
)
OTHER = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{2010}-\x{2027}\x{a0}\x{ab}\x{bb}]+"

# Spellings that mean the same, and the one kept.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("merchantibility", "merchantability"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("favour", "favor"), ("copyright holder", "copyright owner"), ("https://", "http://"),
)

# Public licence texts and notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
#: Whole public licences kept as files.
KNOWN |= {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")}

# Titles that head a licence's text in usual copies.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}


def canonical(text: Column) -> Column:
    """The canonical form of a text column; null is empty."""
    out = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    for other, kept in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(kept))
    return F.trim(F.regexp_replace(out, OTHER, " "))


def canonical_text(text: str) -> str:
    """The same for one string on the driver."""
    pattern = lambda p: re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), p)
    out = re.sub(pattern(COPYRIGHT_LINE), "", text.translate(str.maketrans(_UPPER, _LOWER)))
    for other, kept in SPELLINGS:
        out = out.replace(other, kept)
    return re.sub(pattern(OTHER), " ", out).strip(" ")


def variants(name: str, text: str) -> list[str]:
    """A known text in its usual forms: titled, without the appendix on applying it, without numbers before clauses."""
    out = [text]
    before, end, _ = text.partition("END OF TERMS AND CONDITIONS")
    if end:
        out += [before, before + end]
    if name.startswith("BSD-"):
        out.append(re.sub(r"(?m)^\s*[0-9]\.\s+", "", text))
    return out + [f"{title}\n\n{x}" for title in TITLES.get(name, ()) for x in out]


def digests(known: dict[str, str] | None = None) -> dict[str, str]:
    """Digest -> licence of known texts; of equal ones the name that sorts first."""
    return {hashlib.sha256(canonical_text(v).encode()).hexdigest(): name for name, t in sorted((known or KNOWN).items(), reverse=True) for v in variants(name, t)}


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """``doc_id``, ``n_canonical`` (length), ``digest`` and ``license`` (null: none known) of every whole text.

    Null and empty texts have the digest of the empty string and match no licence;
    repeated rows and null ids are rows like others; other columns are not read;
    an empty table gives no row.  One narrow pass: the join's other side is the
    table of known licences, whose size the caller fixes, and the optimiser
    broadcasts it below its threshold.
    """
    c = docs.select("doc_id", canonical(F.col("text")).alias("canonical"))
    c = c.select("doc_id", F.length("canonical").cast("long").alias("n_canonical"), F.sha2("canonical", 256).alias("digest"))
    rows = [(d, n) for d, n in digests(known).items() if d != hashlib.sha256(b"").hexdigest()]
    table = docs.sparkSession.createDataFrame(rows, "k_digest string, license string") if rows else None
    if table is None:
        return c.withColumn("license", F.lit(None).cast("string"))
    return c.join(table, F.col("digest") == F.col("k_digest"), "left").drop("k_digest")
