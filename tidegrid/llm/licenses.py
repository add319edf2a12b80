"""Licence scans by canonical digests.

A text is brought to a canonical form - lower case, copyright lines out, runs of
anything but letters and digits to one blank, equivalent spellings to one - and
its SHA-256 is hash-joined to the digests of known licences, which go through the
same expressions. The same is done for each line against known one-line notices.

The registry's size is the caller's (a parameter, REGISTRY by default), so it is
broadcast only up to MAX_BROADCAST entries and joined by shuffle beyond.

Edge cases: null, empty and all-punctuation texts have the digest of the empty
text and match nothing; rows with a null doc_id match by their text and get no
notices; rows repeating a doc_id share notices; two registry names with one
canonical text give the lesser name; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm._store import texts

MAX_BROADCAST = 100_000

#: Licences with their SPDX names, the titles they go by, and their texts.
_FULL: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), """Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", ("ISC License", "The ISC License"), """Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", ("zlib License", "The zlib License"), """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The 2-Clause BSD License"), """Copyright (c) <year>, <holder>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The 3-Clause BSD License"), """Copyright (c) <year>, <holder>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), """Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003",), """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", ("The Unlicense",), """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("Apache-2.0", (), """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", (), """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
)

#: One-line notices.
_NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
)

#: Each licence under each of its titles and under none, and the notices.
REGISTRY: tuple[tuple[str, str], ...] = (*((name, f"{title}\n\n{text}") for name, titles, text in _FULL for title in (*titles, "")), *_NOTICES)

#: Spellings that count as the same word, each to the first.
SPELLINGS: tuple[tuple[str, ...], ...] = (
    ("license", "licence"), ("licenses", "licences"), ("licensed", "licenced"), ("sublicense", "sublicence", "sub license", "sub licence"),
    ("merchantability", "merchantibility"), ("organization", "organisation"), ("acknowledgment", "acknowledgement"),
    ("noninfringement", "non infringement"), ("favor", "favour"), ("while", "whilst"), ("noncommercial", "non commercial"), ("owner", "holder"), ("owners", "holders"),
)
#: Words after "copyright" at the start of a line that say that the line is prose, wrapped there.
PROSE = "notice|holder|owner|law|interest|and[ \t]|or[ \t]"
_COPYRIGHT = rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright[ \t](?!(?:{PROSE}))|\(c\)|©|all rights reserved)[^\n]*$"
_NOT_WORD = r"[^\p{L}\p{N}\n]+"


def _respelled(text: Column) -> Column:
    for best, *others in SPELLINGS:
        text = F.regexp_replace(text, f" (?:{'|'.join(others)})(?= )", f" {best}")
    return text


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, its line ends kept, one blank at both ends of each line."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, "")
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(out, _NOT_WORD, " "), "\n", " \n "), F.lit(" "))
    # One search for any spelling spares most texts the replacements; the array keeps the steps before it from being repeated.
    any_other = f" (?:{'|'.join(o for _, *others in SPELLINGS for o in others)}) "
    return F.transform(F.array(out), lambda x: F.when(x.rlike(any_other), _respelled(x)).otherwise(x))[0]


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_lines(text), "[ \n]+", " "))


def digests(spark: SparkSession, registry: Sequence[tuple[str, str]] = REGISTRY) -> DataFrame:
    """digest, license: of the canonical forms of the registry's texts."""
    known = spark.createDataFrame(list(registry), "license string, text string")
    known = known.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    known = known.groupBy("digest").agg(F.min("license").alias("license")).where(F.col("digest") != F.sha2(F.lit(""), 256))
    return F.broadcast(known) if len(registry) <= MAX_BROADCAST else known


def scan(docs: DataFrame, registry: Sequence[tuple[str, str]] = REGISTRY) -> DataFrame:
    """doc_id, digest (of the whole canonical text), license (null if unknown), notices (names of known one-line notices, sorted, joined by commas)."""
    known = digests(docs.sparkSession, registry)
    rows = texts(docs).select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    whole = rows.select("doc_id", F.sha2(F.trim(F.regexp_replace("lines", "[ \n]+", " ")), 256).alias("digest"))
    whole = whole.join(known, "digest", "left")
    # Lines are looked up before anything is shuffled; only the few that match go on.
    lines = rows.select("doc_id", F.explode(F.array_distinct(F.split("lines", "\n"))).alias("line"))
    lines = lines.select("doc_id", F.sha2(F.trim(F.regexp_replace("line", " +", " ")), 256).alias("digest")).join(known, "digest")
    notices = lines.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    return whole.join(notices, "doc_id", "left").select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
