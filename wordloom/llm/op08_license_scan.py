"""License scans by diagonal voting, with DataFrame functions alone.

Texts are cut into words once. The rolling word 3-grams of those that hold a telling word of any template are hashed
from their words' hashes and joined to the templates' 3-grams, by hash and then by words. Each match votes for a
diagonal, its place in the text less its place in the template; votes are added up by document, template and diagonal.
Diagonals up to a tenth of the template's words (or `slack`) beyond one form a span with it, so words put in or left out
do not break it, and a span cannot drift further. A span whose votes cover `coverage` of the template's 3-grams is
verified on the text's words: taken in order, they must differ from the template's in no more than the rest (words put
in, left out or replaced), and agree with it in what tells licences apart (lesser, affero, noncommercial, sharealike, no
derivatives, negations, a version that the template names). A phrase of the base list or a licence's name holds where
all its 3-grams vote for one diagonal, that is, where its words stand one after the other; names find the short lines
that share too little with a passage.

Telling words: each phrase has one of them, and of each template so many 3-grams hold one that no span without any can
reach `coverage`. So texts without telling words have no label, and they are most; the others' words are stored.
The templates' 3-grams are some thousands of rows, whatever the input, and are broadcast. No other text is shuffled.

Defined results: null text counts as empty; texts without words have no places, no labels and score 0; repeated rows get
the same result each; a null doc_id is matched like any other; where several spans of a template overlap, each that
holds counts for the label, and the score is the best one's share of words in order; an empty table gives no rows; only
the id and text columns are read. Phrases of fewer than three words are not found.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

K = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the base list and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Opening or naming passages of public licences, lower-cased and without punctuation, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "lgpl": "you can redistribute it and or modify it under the terms of the gnu lesser general public license",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

# Whole texts of short public licences and the notices of long ones, by label.
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
        dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
        copyright law.""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire
        statement, including the above license grant, this restriction and the following disclaimer, must be included in all
        copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
        works are solely in the form of machine-executable object code generated by a source language processor.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
        for more details.""",
    "agpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License
        for more details.""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

# Names of public licences as short notices give them, by label; the spelling "licence" is added below.
_NAMES = {
    "mit": ["the mit license", "mit open source license", "spdx license identifier mit"],
    "apache-2": [
        *("apache license 2 0", "apache license version 2 0", "apache license v 2 0", "apache license v2 0", "apache software license 2 0", "apache software license version 2 0", "apache public license 2 0"),
        *("apache 2 0 license", "apache v2 0 license", "apache version 2 0 license", "spdx license identifier apache 2 0"),
    ],
    "apache-1": ["apache license version 1 1", "apache license 1 1", "apache software license version 1 1", "apache software license 1 1", "spdx license identifier apache 1 1"],
    "bsd": [
        *("the bsd license", "bsd style license", "new bsd license", "modified bsd license", "revised bsd license", "simplified bsd license"),
        *(x for n in "234" for x in (f"bsd {n} clause", f"{n} clause bsd")),
    ],
    "gpl": [
        *("gnu general public license", "the gnu gpl", "gnu gpl version", "gnu gpl license", "spdx license identifier gpl"),
        *(x for n in "123" for x in (f"gnu gpl {n}", f"gnu gpl v{n}", f"gpl version {n}", f"gpl {n} 0", f"gpl v{n} license", f"the gpl v{n}")),
    ],
    "lgpl": [
        *("gnu lesser general public license", "gnu library general public license", "the gnu lgpl", "gnu lgpl version", "gnu lgpl license", "spdx license identifier lgpl"),
        *(x for n in ("2", "2 1", "3") for x in (f"gnu lgpl {n}", f"gnu lgpl v{n}", f"lgpl version {n}")), "lgpl 2 1", "lgpl 3 0",
    ],
    "agpl": ["gnu affero general public license", "the gnu agpl", "gnu agpl version", "gnu agpl v3", "gnu agpl 3", "agpl version 3", "agpl 3 0", "spdx license identifier agpl"],
    "mpl-2": [
        *("mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mpl 2 0", "mpl version 2 0", "mpl v 2 0"),
    ],
    "mpl-1": ["mozilla public license 1 1", "mozilla public license version 1 1", "mozilla public license v 1 1", "mozilla public license v1 1", "mpl 1 1", "mpl version 1 1"],
    "epl": ["eclipse public license", "spdx license identifier epl"],
    "eupl": ["european union public license", "spdx license identifier eupl"],
    "gfdl": ["gnu free documentation license", "the gnu fdl", "spdx license identifier gfdl"],
    "isc": ["the isc license", "spdx license identifier isc"],
    "zlib": ["the zlib license", "spdx license identifier zlib"],
    "boost": ["boost software license", "spdx license identifier bsl 1 0"],
    "artistic": ["the artistic license", "artistic license 1 0", "artistic license 2 0", "spdx license identifier artistic"],
    "unlicense": ["under the unlicense", "spdx license identifier unlicense"],
    "cc0": ["cc0 1 0", "creative commons zero", "creative commons cc0", "creative commons public domain dedication"],
}

# Creative Commons licences: the name's words by label. What follows tells a name from a longer one.
_CC = {
    "cc-by": ["attribution"],
    "cc-by-sa": ["attribution sharealike", "attribution share alike"],
    "cc-by-nd": ["attribution noderivatives", "attribution noderivs", "attribution no derivatives", "attribution no derivs"],
    "cc-by-nc": ["attribution noncommercial", "attribution non commercial"],
    "cc-by-nc-sa": ["attribution noncommercial sharealike", "attribution noncommercial share alike", "attribution non commercial sharealike", "attribution non commercial share alike"],
    "cc-by-nc-nd": [f"attribution {nc} {nd}" for nc in ("noncommercial", "non commercial") for nd in ("noderivatives", "noderivs", "no derivatives", "no derivs")],
}
for _label, _spelt in _CC.items():
    _short = _label.replace("-", " ")
    _ends = ["license", "international", "unported", "1 0", "2 0", "2 5", "3 0", "4 0"]
    _NAMES[_label] = [f"{words} {end}" for words in ("creative commons " + x for x in _spelt) for end in _ends] + [f"{_short} {end}" for end in _ends] + [f"creative commons {_short} {end}" for end in _ends]

NAMES = {x: label for label, phrases in _NAMES.items() for phrase in phrases for x in (phrase, phrase if phrase.startswith("spdx") else phrase.replace("license", "licence"))}


# Words that make another licence, or its opposite, of the same passage; a span has the ones of its template and no others.
_TELLING = r"\b(lesser|library(?= general)|affero|non ?commercial|share ?alike|no ?deriv|not\b|never\b|no longer)"
_VERSION = r"\blicen[cs]e (?:version |v )?v?(\d+)"


def _agrees(span: Column, passage: Column) -> Column:
    """Whether a span's words tell of the same licence as the passage, and of its version where the passage names one."""
    telling = lambda x: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(_TELLING), F.lit(1)), lambda t: F.translate(t, " ", ""))))
    version = lambda x: F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(_VERSION), F.lit(1))))
    return (telling(span) == telling(passage)) & ((F.size(version(passage)) == 0) | (version(span) == version(passage)))


#: Words that ordinary texts have, too; they tell of a licence only if a phrase has no other.
_PLAIN = set("a an and any are as at be by for free if in is it may not of on or that the this to use with without you v version work works open new style".split())
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """A text's words, A-Z lower-cased, without regular expressions."""
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase + _SEPARATORS, string.ascii_lowercase + " " * len(_SEPARATORS)), " "), "")


def plain_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def telling_words(kinds: list[tuple[list[str], str, bool, bool]], coverage: float) -> list[str]:
    """Words of which every whole phrase, and every span that covers enough of a template, has one at least."""
    telling: set[str] = set()
    rank = lambda w: (w in _PLAIN or w.isdigit(), -len(w), w)
    for words, _, _, whole in sorted(kinds, key=lambda k: (not k[3], len(k[0]))):
        bare = lambda: sum(telling.isdisjoint(words[i : i + K]) for i in range(len(words) - K + 1))  # noqa: B023, E731
        for word in sorted(set(words), key=rank):
            if telling.isdisjoint(words) if whole else bare() >= coverage * (len(words) - K + 1):
                telling.add(word)
    return sorted(telling)


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, names: dict[str, str] | None = None, coverage: float = 0.8, slack: int = 2
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    base, names: phrase to label; templates: pairs of label and text.
    """
    spark = docs.sparkSession
    base, names = BASE if base is None else base, NAMES if names is None else names
    templates = [*TEMPLATES.items(), *TEXTS.items()] if templates is None else templates
    kinds = [*((text, label, True, True) for text, label in base.items()), *((text, label, False, True) for text, label in names.items()), *((text, label, False, False) for label, text in templates)]
    kinds = [(plain_words(text), *rest) for text, *rest in kinds]
    kinds = [x for x in kinds if len(x[0]) >= K]
    grams = [(i, at, *words[at : at + K]) for i, (words, *_) in enumerate(kinds) for at in range(len(words) - K + 1)]
    hash_ = lambda *words: F.xxhash64(*map(F.xxhash64, words))
    known = spark.createDataFrame(grams, "template int, at int, w0 string, w1 string, w2 string").withColumn("hash", hash_("w0", "w1", "w2"))
    hashes = [r["hash"] for r in known.select("hash").distinct().collect()]  # as many as the templates have 3-grams
    furthest = lambda words: max(slack, len(words) // 10)
    about = spark.createDataFrame([(i, label, is_base, whole, words, len(words) - K + 1, furthest(words)) for i, (words, label, is_base, whole) in enumerate(kinds)], "template int, label string, is_base boolean, whole boolean, passage array<string>, n_grams int, drift int")
    most_drift = max((furthest(words) for words, _, _, whole in kinds if not whole), default=0)
    telling = F.array(*map(F.lit, telling_words(kinds, coverage))).cast("array<string>")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words"))
    with scratch() as keep:
        rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", telling), F.col("words")).alias("words"))
        rows = stored(rows, "license-words")
        able = rows.where("words is not null").select("row", "words")
        own = F.transform("words", lambda w: F.xxhash64(w))
        rolled = able.select("row", "words", own.alias("h")).where(F.size("h") >= K)
        places = F.transform(F.sequence(F.lit(0), F.size("h") - K), lambda i: F.struct(i.alias("place"), F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)).alias("hash")))
        hits = F.transform(F.filter(places, lambda x: x["hash"].isin(hashes)), lambda x: F.struct(x["place"].alias("place"), x["hash"].alias("hash"), F.slice("words", x["place"] + 1, K).alias("gram")))
        votes = rolled.select("row", F.explode(hits).alias("x")).select("row", "x.*").join(F.broadcast(known), "hash").where(F.col("gram") == F.array("w0", "w1", "w2"))
        votes = votes.groupBy("row", "template", (F.col("place") - F.col("at")).cast("long").alias("diagonal")).agg(F.collect_set("at").alias("covered"), F.min("place").alias("first"), F.max("place").alias("last"))
        votes = stored(votes.join(F.broadcast(about), "template"), "license-votes")

        phrases = votes.where(F.col("whole") & (F.size("covered") == F.col("n_grams"))).select("row", "label", "is_base", "diagonal", F.lit(1.0).alias("share"))
        near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, most_drift)
        spans = votes.where("not whole").withColumn("near", F.collect_list(F.struct("diagonal", "covered", "first", "last")).over(near))
        spans = spans.withColumn("near", F.filter("near", lambda x: x["diagonal"] <= F.col("diagonal") + F.col("drift")))
        spans = spans.where(F.size(F.array_distinct(F.flatten(F.col("near.covered")))) >= coverage * F.col("n_grams"))
        # From where the template's first word would stand to where its last one would, by the outermost votes.
        begin = F.greatest(F.array_min(F.transform("near", lambda x: F.struct(x["first"], x["diagonal"].alias("d"))))["d"], F.lit(0))
        end = F.array_max(F.transform("near", lambda x: F.struct(x["last"], x["diagonal"].alias("d"))))["d"] + F.size("passage")
        spans = spans.select("row", "label", "is_base", "diagonal", "passage", begin.cast("int").alias("begin"), end.cast("int").alias("end"))
        inside = stored(spans, "license-spans").join(able, "row").withColumn("inside", F.slice("words", F.col("begin") + 1, F.col("end") - F.col("begin")))
        inside = inside.where(_agrees(F.array_join("inside", " "), F.array_join("passage", " ")))
        inside = inside.select("row", "label", "is_base", "diagonal", F.size("passage").alias("n"), _differing("inside", "passage").alias("differing"))
        passages = inside.where(F.col("differing") <= (1 - coverage) * F.col("n") + 1e-9).select("row", "label", "is_base", "diagonal", (1 - F.col("differing") / F.col("n")).alias("share"))
        found = phrases.unionByName(passages).groupBy("row").agg(
            F.sum(F.col("is_base").cast("long")).alias("n_base"),
            F.min(F.when(F.col("is_base"), F.col("diagonal"))).alias("first_word"),
            F.max(F.when(F.col("is_base"), F.col("diagonal"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("share").alias("score"),
        )
        found = stored(found, "license-found")
        keep(rows, found)
    out = rows.select("row", "doc_id", "n_words").join(found, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _differing(inside: str, passage: str) -> Column:
    """How many words must be put in, left out or replaced to make one list of words of the other, in order."""
    alphabet = F.lit("".join(chr(0x4E00 + i) for i in range(1000)))  # a character for each distinct word of a passage; 0 for others
    own = F.array_distinct(passage)
    coded = lambda words: F.array_join(F.transform(words, lambda w: F.when(F.array_contains(own, w), F.substr(alphabet, F.array_position(own, w).cast("int"), F.lit(1))).otherwise(F.lit("0"))), "")
    return F.levenshtein(coded(inside), coded(passage))
