"""Licence scans: windows of a text against licence templates by Dice coefficient over word bigrams.

DataFrame functions only; the templates are a fixed list, so they are literals.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Licence, notice.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
)

_FREE = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_SOURCE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD = _SOURCE + "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: The longest notice of each licence.
_NOTICE = dict(sorted(TEMPLATES, key=lambda x: len(x[1])))
_GRANT = _NOTICE["MIT"].removesuffix(", subject to the following conditions:")
_FEE = _NOTICE["ISC"].partition(", provided that")[0]
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ACKNOWLEDGE = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
_FREEDOM = "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public {} intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. "
_WORKS = "is a free, copyleft license for software and other kinds of works{} The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, "
#: Whole licences, standard headers and how the longest licences begin; where one is found, weaker matches of other licences go.  Lists are not numbered here, so that numbers are versions.
WHOLE = (
    ("MIT", _NOTICE["MIT"] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", _NOTICE["ISC"] + " " + _ISC_AS_IS),
    ("0BSD", _FEE + ". " + _ISC_AS_IS),
    ("MIT-0", _GRANT + ". " + _AS_IS),
    ("BSD-1-Clause", _SOURCE + _BSD_AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _NEITHER + _BSD_AS_IS),
    ("BSD-4-Clause", _BSD + _ACKNOWLEDGE + _NEITHER + _BSD_AS_IS),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Apache-2.0", _NOTICE["Apache-2.0"] + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", _NOTICE["MPL-2.0"]),
    ("GPL-2.0", _FREE.format(what="program", mark=";", name="GNU General Public License", version="2")),
    ("GPL-3.0", _FREE.format(what="program", mark=":", name="GNU General Public License", version="3")),
    ("LGPL-2.1", _FREE.format(what="library", mark=";", name="GNU Lesser General Public License", version="2.1")),
    ("LGPL-3.0", _FREE.format(what="program", mark=":", name="GNU Lesser General Public License", version="3")),
    ("AGPL-3.0", _FREE.format(what="program", mark=":", name="GNU Affero General Public License", version="3")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 Definitions \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."),
    ("GPL-2.0", _FREEDOM.format("License is") + "This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it."),
    ("LGPL-2.1", _FREEDOM.format("Licenses are") + "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it."),
    ("GPL-3.0", "The GNU General Public License " + _WORKS.format(".") + "the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("AGPL-3.0", "The GNU Affero General Public License " + _WORKS.format(", specifically designed to ensure cooperation with the community in the case of network server software.") + "our General Public Licenses are intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
)
#: Lines that name a licence by its identifier, one for each licence above.
SPDX = tuple((name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES + WHOLE}))
#: Words that are in most texts, so not looked for first; words that turn a notice round when they stand in it or right before it, and the notice has fewer.
COMMON = ("by", "under")
NEGATIONS = ("cannot", "neither", "never", "nor", "not")


def normalise(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def in_order(words: list[str]) -> list[str]:
    """The same bigrams by their first place."""
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def bounds(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """The least and most bigrams that a set may have to reach threshold against one of this size."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def anchors(words: list[str], threshold: float = THRESHOLD) -> set[str]:
    """Words of which a segment must hold one: without all of them, too few of the template's bigrams remain."""
    pairs = {tuple(p.split(" ")) for p in bigrams(words)}
    spare = len(pairs) - bounds(len(pairs), threshold)[0]
    out: set[str] = set()
    for w in sorted(set(words), key=lambda w: (w in COMMON, -len(w), w)):
        if sum(bool(out & set(p)) for p in pairs) > spare:
            break
        out.add(w)
    return out


def versions(words: list[str]) -> list[str]:
    """The runs of numbers of a template, as patterns of the same runs in words joined by spaces: 2 isn't 2.1."""
    runs = re.findall(r"(?<![a-z0-9])[0-9]+(?: [0-9]+)*(?![a-z0-9])", " ".join(words))
    return [rf"(?<![a-z0-9])(?<!(?<![a-z0-9])[0-9]{{1,9}} ){r}(?![a-z0-9])(?! [0-9]+(?![a-z0-9]))" for r in sorted(set(runs))]


def find_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id, segment, license, dice): a row for every place of a text and licence that match.

    Both sides are lower-cased, everything but a-z and 0-9 parts words.  A
    window has as many words as the template, fewer at a text's end, and begins
    with a bigram of the template: another that matches can be moved to one
    without loss of bigrams.  The template's version numbers must occur in it,
    and a notice has no more negations than its template, from the word before
    where it would begin to the window's end.  Windows that overlap are one
    place, whose segment is the first word of the one with most bigrams in
    common, less half of those that differ.  Of several templates of one licence
    the best counts.  Null and empty texts match none; rows that repeat are reported
    once each; an empty table gives no row.
    """
    forms = [(name, normalise(text), whole) for whole, group in ((False, TEMPLATES), (True, WHOLE + SPDX)) for name, text in group]
    must = sorted(set().union(*(anchors(w, threshold) for _, w, _ in forms)))
    t = F.lower(F.col(text_col))
    likely = t.rlike("(?<![a-z0-9])(?:" + "|".join(must) + ")(?![a-z0-9])")
    words = F.array_remove(F.split(F.regexp_replace(t, "[^a-z0-9]+", " "), " "), "")
    # each step is made once a row: an explode, as projections and filters over them would be joined and made again for every element
    step = lambda rows, made, name: rows.select("*", F.explode(F.array(made)).alias(name))
    rows = step(docs.where(likely).select(F.col(id_col).alias("id"), F.col(text_col)), words, "w").where(F.size("w") > 1).select("id", "w")
    rows = step(rows, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1))), "b")
    every = sorted(set().union(*(bigrams(w) for _, w, _ in forms)))
    rows = step(rows, F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda i: F.get("b", i).isin(every)), "at")
    data = [{"license": name, "whole": whole, "n": len(w), "own": in_order(w), "least": bounds(len(bigrams(w)), threshold)[0], "versions": versions(w), "negations": len(w) if whole else sum(x in NEGATIONS for x in w)} for name, w, whole in forms]
    templates = F.from_json(F.lit(json.dumps(data)), "array<struct<license string, whole boolean, n int, own array<string>, least int, versions array<string>, negations int>>")

    def matches(x: Column) -> Column:
        def match(s: Column) -> Column:
            b = F.array_distinct(F.slice("b", s + 1, x["n"] - 1))
            common = F.size(F.array_intersect(b, x["own"]))
            # a number at either end goes on in the word beyond it
            number = lambda i: F.get("w", i).rlike("^[0-9]+$")
            span = F.concat_ws(" ", F.when(number(s), F.get("w", s - 1)), F.slice("w", s + 1, x["n"]), F.when(number(s + x["n"] - 1), F.get("w", s + x["n"])))
            back = F.least(s, F.array_position(x["own"], F.get("b", s)).cast("int"))
            turned = F.size(F.filter(F.slice("w", s - back + 1, x["n"] + back), lambda v: v.isin(*NEGATIONS)))
            ok = F.forall(x["versions"], lambda v: F.rlike(span, v)) & (turned <= x["negations"])
            return F.struct((2.0 * common - (F.size(b) + F.size(x["own"])) / 2).alias("score"), (2 * common / (F.size(b) + F.size(x["own"]))).alias("dice"), (-s).alias("start"), (s + x["n"]).alias("end"), x["license"].alias("license"), x["whole"].alias("whole"), ok.alias("ok"))

        hits = F.filter("at", lambda i: F.array_contains(x["own"], F.get("b", i)))
        starts = F.flatten(F.transform(F.array(hits), lambda h: F.filter(h, lambda p, k: F.get(h, k + x["least"] - 1) <= p + x["n"] - 2)))
        return F.filter(F.transform(starts, match), lambda m: m["ok"] & (m["dice"] >= threshold))

    found = F.reverse(F.array_sort(F.flatten(F.transform(templates, matches))))
    rows = step(rows.where(F.size("at") > 0), found, "m").where(F.size("m") > 0).select("id", "m")
    # from the best down, a match that overlaps no place makes one
    meets = lambda x, y: (-x["start"] < y["end"]) & (-y["start"] < x["end"])
    none = F.filter("m", lambda x: F.lit(False))
    places = F.aggregate("m", none, lambda kept, x: F.when(F.exists(kept, lambda y: meets(x, y)), kept).otherwise(F.array_append(kept, x)))
    rows = step(rows, places, "places").select("id", "places", F.explode("m").alias("m"))
    rows = rows.withColumn("place", F.get(F.filter("places", lambda y: meets(F.col("m"), y)), F.lit(0)))
    best = rows.where(~F.col("place.whole") | (F.col("place.license") == F.col("m.license")))
    best = best.groupBy("id", (-F.col("place.start")).alias("segment"), F.col("m.license").alias("license")).agg(F.max("m.dice").alias("dice"))
    return best.withColumnRenamed("id", id_col)


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_matches, licenses, best_dice) for the documents in which a licence is found; licences sorted, comma-joined."""
    found = find_licenses(docs, text_col, id_col)
    return found.groupBy(id_col).agg(F.countDistinct("segment").alias("n_matches"), F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("licenses"), F.round(F.max("dice"), 6).alias("best_dice"))
