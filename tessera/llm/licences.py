"""Licence scans by canonical digest: whole texts, and single lines of a text, against digests of known licences and notices.

Texts are brought to a canonical form: A-Z to a-z, copyright lines dropped, ASCII punctuation and white space to single blanks, equivalent spellings
to one. The digest of the whole form is hash-joined to the digests of known texts in the same form: a fixed table of digests, and whatever table of
whole texts is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII punctuation and white space.
BETWEEN = r"[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"
#: Lines of lower-cased texts that go: they begin with a copyright sign and name a year or have a sign, or reserve all rights.
COPYRIGHT = r"(?s)^[^a-z0-9]*(?:copyright|\(c\)|©).*(?:[0-9]|\(c\)|©)|^[^a-z0-9]*all rights reserved[^a-z0-9]*$"
#: Fixed list: equivalent spellings, after lower-casing and dropping punctuation; those of two words come after those of one.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("licencee", "licensee"), ("licencees", "licensees"), ("licencor", "licensor"), ("sublicence", "sublicense"), ("sublicences", "sublicenses"), ("sublicenced", "sublicensed"), ("sublicencing", "sublicensing"), ("relicencing", "relicensing"), ("organisation", "organization"), ("recognise", "recognize"), ("whilst", "while"), ("favour", "favor"), ("https", "http"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("e mail", "email"))
#: Fixed texts: short licences, and notices that stand for a licence where they are a line.
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEXTS = (
    ("MIT", "MIT License\n\nCopyright (c) 2000 Someone\n\n" + GRANT + AS_IS),
    ("MIT", "The MIT License (MIT)\n\n" + GRANT + AS_IS),
    ("MIT", GRANT + AS_IS),
    ("ISC", "ISC License\n\nCopyright (c) 2000 Someone\n\n" + ISC),
    ("ISC", ISC),
)
NOTICES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
)
#: sha256 of the canonical forms of whole licence texts as their publishers and packages print them.
DIGESTS = (
    ("0BSD", "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("Apache-2.0", "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea"),
    ("Apache-2.0", "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("Artistic-1.0", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-2-Clause", "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", "0af6267f495661a9c4f72f474602031f4e40485e3f4d0ab8e79bb5cc1c3f507f"),
    ("BSD-3-Clause", "15f57ceac50496fc4b9d7b36a66f4d5cfd98ed43eaa713f737dff3aa3a2b2ff1"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "472cbe328f601b74a1a7cdc5e4e96e99ad3c80bf284b023be0128764a94a1a7d"),
    ("BSD-3-Clause", "8ea8b8d56b60a1c8c3272bd44402057aa62f99b6d36d425e8659eed020e2f756"),
    ("BSD-3-Clause", "9571a4bcffc19a829f55bd46047cb5279e7a9e08aa1b47b88ee84f3d0ab912cc"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "b6093f80a67d752fa17301d7c8f20fe906e6f11169f3a64f9a5816d148eb738f"),
    ("BSD-3-Clause", "c165caf2263156afde96f4b02327c2ba96c47bd8cff887df37a4210399885793"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "d047e3d622526e339bf42277d2adb7fb932ad2e26e162bad5254b96ff6aeacde"),
    ("BSD-3-Clause", "d5a306a2b3c2187b0ca64abfdd2f2fde60301b4e4864a4a9de25ef3c86e30207"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "eec4ddff69cec880911ad2275d11a822b8ad0f4a6495488ef74849963182fdc8"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "3fac9a11e4366b1fbe1532f00386554a15e9f27d02bf06aed439155813727b3f"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "0c16f9c6e202d1a21811642f6c5098ab140898c6b3c421fcbe4aa41fb5d92c29"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", "b231082d360c8acd5c69c2395f37e102297f2bf41fed4d545f1cbdcce0317456"),
    ("MIT", "bfd6b9d0a4f030ab0e7acaafcf8498cb05002c173bbc354fa68b7e188aaf90ee"),
    ("MPL-1.1", "7225b0001bd95a632194e617575add06ce2e69da0b6dac31dc9a4943dda300eb"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
#: A line that names none of these can't be a known notice.
HINTS = ("licen", "permission", "apache", "software")


def canonical(text: Column, lines: bool = True) -> Column:
    """The canonical form; lines tells that copyright lines may have to go. Null stays null."""
    plain = F.translate(text, UPPER, LOWER)
    if lines:
        left = F.array_join(F.filter(F.split(plain, "\n"), lambda x: ~x.rlike(COPYRIGHT)), "\n")
        plain = F.when(plain.contains("copyright") | plain.contains("(c)") | plain.contains("©") | plain.contains("all rights reserved"), left).otherwise(plain)
    plain = F.trim(F.regexp_replace(plain, BETWEEN, " "))
    wide = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))  # each word has its own blanks
    for other, one in SPELLINGS:
        wide = F.replace(wide, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {one} "))
    spelt = F.lit(False)
    for other, _ in SPELLINGS:
        spelt = spelt | plain.contains(other)
    return F.when(spelt, F.trim(F.replace(wide, F.lit("  "), F.lit(" ")))).otherwise(plain)


def digest(text: Column, lines: bool = True) -> Column:
    return F.sha2(canonical(text, lines), 256)


def known(spark, texts: DataFrame | None = None) -> DataFrame:
    """digest, licence_id: a row for each different known text; the smallest id where several have one digest. texts (licence_id, text) come
    beside the fixed ones; rows without id or text are left out."""
    own = spark.createDataFrame([*TEXTS, *NOTICES], "licence_id string, text string").select("licence_id", digest(F.col("text")).alias("digest"))
    own = own.unionByName(spark.createDataFrame([*DIGESTS], "licence_id string, digest string"))
    if texts is not None:
        own = own.unionByName(texts.where("licence_id IS NOT NULL AND text IS NOT NULL").select("licence_id", digest(F.col("text")).alias("digest")))
    return own.groupBy("digest").agg(F.min("licence_id").alias("licence_id"))


def scan(docs: DataFrame, texts: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, canonical_sha256, licence_id (the whole text is that licence; null if none), notices (ids of
    licences that single lines give, sorted and distinct, joined by commas; empty if none).

    texts (licence_id, text) are known licences beside the fixed ones; any number of them, they are joined by digest and sent to all tasks only if
    Spark finds them small. Lines are held against the fixed notices and short texts. Null texts are empty ones, which are no licence. Rows without
    doc_id and repeated rows are scanned like others. Other columns are not looked at.
    """
    spark = docs.sparkSession
    table = known(spark, texts)
    table = F.broadcast(table) if texts is None else table  # the fixed ones are some sixty rows
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    names = {r.digest: r.licence_id for r in known(spark).collect()}  # the fixed rows
    fixed = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    hint = "(?i)" + "|".join(HINTS)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(hint))
    found = F.transform(lines, lambda x: F.element_at(fixed, digest(x, lines=False)))
    notices = F.when(F.col("t").rlike(hint), F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",")).otherwise("")
    digested = own.select("doc_id", digest(F.col("t")).alias("canonical_sha256"), notices.alias("notices"))
    out = digested.join(table.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left")
    return out.select("doc_id", "canonical_sha256", "licence_id", "notices")
