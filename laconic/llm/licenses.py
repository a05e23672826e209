"""Operator 4, licence scans: whole texts in canonical form, joined by digest to known licences.

The canonical form follows the usual matching guidelines: case, punctuation and white space do not
count, copyright lines go, equivalent spellings are made one. All of it is built-in expressions in
one projection; the known digests are a literal table of fixed size, so the join is broadcast.
"""

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laconic.llm.common import table

_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT_HEAD = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Known texts by identifier, with the titles under which they also go.
KNOWN: dict[str, tuple[str, ...]] = {
    "MIT": (f"{_MIT_HEAD}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_MIT_TAIL}",),
    "MIT-0": (f"{_MIT_HEAD}.\n{_MIT_TAIL}",),
    "ISC": (f"{_PERMIT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_TAIL}",),
    "0BSD": (f"{_PERMIT}.\n{_ISC_TAIL}",),
    "BSD-2-Clause": (_BSD_HEAD + _BSD_TAIL,),
    "BSD-3-Clause": (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL,),
    "Zlib": (_ZLIB,),
}
_TITLES = {"MIT": "MIT License", "MIT-0": "MIT No Attribution", "ISC": "ISC License", "0BSD": "Zero-Clause BSD", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"}

#: SHA-256 of the canonical form of long licences, whole and without their appendix on how to apply them.
LONG: dict[str, str] = {
    "0be25ae8b112b6c47bf696a745855eebba678079747ad8bbf877d928555027f1": "Apache-2.0",
    "9446b99128ec9c3946adbb681853599f3a5f01a69d6c0762a9d0ab699868d801": "Apache-2.0",
    "c46dfd45ed4a19fe4a99eaed08590a0c093e3a0b73c293ece466f468b902aff3": "Apache-2.0",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0-Perl",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b": "GFDL-1.2",
    "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d": "GFDL-1.3",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0",
    "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70": "GPL-1.0",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191": "GPL-3.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2": "LGPL-2.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61": "MPL-1.1",
    "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56": "MPL-2.0",
    "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd": "Unlicense",
}
#: Short notices of a licence, and the names under which it goes in them besides its title and identifier.
_NOTICES = ("{verb} under the {name}", "{verb} under {name}", "{verb} under the terms of the {name}")
_VERBS = tuple(f"{s}{v}" for s in ("", "This project is ", "This software is ", "This work is ", "This file is ", "This code is ") for v in ("released", "licensed", "distributed", "available"))
_NAMES = {
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0"), "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"), "Unlicense": ("Unlicense",),
    "GPL-2.0": ("GNU General Public License v2.0", "GNU General Public License version 2", "GPLv2"), "GPL-3.0": ("GNU General Public License v3.0", "GNU General Public License version 3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License v2.1", "LGPLv2.1"), "LGPL-3.0": ("GNU Lesser General Public License v3.0", "LGPLv3"), "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"),
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ‘’“”–—‐ ", "abcdefghijklmnopqrstuvwxyz''\"\"--- "
_NOTICE = r"(^|\n)[^a-z0-9\n]*(copyright[^\n]*([0-9]{4}|\(c\)|©)|\(c\)|©|all rights reserved)[^\n]*"
_SPELLINGS = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"),
    ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"), ("sub-license", "sublicense"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("https://", "http://"), ("&", " and "),
)
_PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: str) -> str:
    """The canonical form of one text."""
    text = re.sub(_NOTICE, "\n", text.translate(str.maketrans(_UPPER, _LOWER)))
    for other, one in _SPELLINGS:
        text = text.replace(other, one)
    return re.sub(_PUNCTUATION, " ", text).strip(" ")


def canonical_column(text: Column) -> Column:
    """The same as built-in expressions; null is empty."""
    text = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NOTICE, "\n")
    for other, one in _SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(one))
    return F.trim(F.regexp_replace(text, _PUNCTUATION, " "))


def short_notices() -> list[tuple[str, str]]:
    """(text, identifier) of notices that say no more than under which licence something is, and of SPDX lines."""
    names = {**{k: (v,) for k, v in _TITLES.items()}, **_NAMES}
    out = []
    for key, own in names.items():
        out.append((f"SPDX-License-Identifier: {key}", key))
        out += [(n.format(verb=v, name=x), key) for x in (*own, key) for v in _VERBS for n in _NOTICES]
    return out


def known_digests(known: dict[str, tuple[str, ...]] = KNOWN) -> list[tuple[str, str]]:
    """(digest, identifier) of each known text, alone and under its title; digests once."""
    found: dict[str, str] = {}
    for name, forms in known.items():
        for form in forms:
            for text in (form, f"{_TITLES.get(name, name)}\n{form}", f"The {_TITLES.get(name, name)}\n{form}"):
                found.setdefault(hashlib.sha256(canonical(text).encode()).hexdigest(), name)
    if known is KNOWN:
        for digest, name in LONG.items():
            found.setdefault(digest, name)
        for text, name in short_notices():
            found.setdefault(hashlib.sha256(canonical(text).encode()).hexdigest(), name)
    return sorted(found.items())


def find_licenses(docs: DataFrame, known: dict[str, tuple[str, ...]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, canonical_sha256, canonical_words, license_id), one for each row of docs.

    license_id is null where the whole text is no known licence. Null, empty and wordless texts have
    the digest of the empty text, which is no licence. Other columns are ignored.
    """
    digests = docs.sparkSession.createDataFrame(known_digests(known), "canonical_sha256 string, license_id string")
    form = docs.select(id_col, canonical_column(F.col(text_col)).alias("_form"))
    words = F.when(F.col("_form") == "", F.lit(0)).otherwise(F.length("_form") - F.length(F.translate("_form", " ", "")) + 1)
    rows = form.select(id_col, F.sha2("_form", 256).alias("canonical_sha256"), words.cast("long").alias("canonical_words"))
    return rows.join(F.broadcast(digests), "canonical_sha256", "left").select(id_col, "canonical_sha256", "canonical_words", "license_id")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, canonical_sha256, canonical_words, license_id."""
    return find_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    text = f"regexp_replace(translate(coalesce(text, ''), {quoted(_UPPER)}, {quoted(_LOWER)}), {quoted(_NOTICE)}, chr(10), 'g')"
    for other, one in _SPELLINGS:
        text = f"replace({text}, {quoted(other)}, {quoted(one)})"
    rows = ", ".join(f"({quoted(d)}, {quoted(n)})" for d, n in known_digests())
    return f"""
WITH known(digest, license_id) AS (VALUES {rows}),
d AS (SELECT doc_id, trim(regexp_replace({text}, {quoted(_PUNCTUATION)}, ' ', 'g'), ' ') AS form FROM documents)
SELECT doc_id, sha256(form) AS canonical_sha256, (CASE WHEN form = '' THEN 0 ELSE length(form) - length(replace(form, ' ', '')) + 1 END)::BIGINT AS canonical_words, license_id
FROM d LEFT JOIN known ON sha256(form) = digest"""


ORACLE = _oracle()
