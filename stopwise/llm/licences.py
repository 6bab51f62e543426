"""Licence recognition by sentences and ordered rules, in DataFrame expressions only.

A text is cut into sentences, each is reduced to lower-case letters, digits and single spaces, and
the sentences that some licence is made of become their numbers, also where line ends or colons cut
them into several. A rule is a sequence of numbers; it matches where they follow one another, with
few unknown sentences between.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and notices; {} stands for one to twelve words, such as a holder's name. A sentence's number is its place here, from 1.
SENTENCES = [
    "Released under the MIT License.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "See the License for the specific language governing permissions and limitations under the License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "See the GNU General Public License for more details.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Licensed under CC BY-NC 4.0.",
    "Licensed under CC BY 4.0.",
    "Licensed under CC BY-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "This is free and unencumbered software released into the public domain.",
    "All rights reserved.",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "See the GNU Affero General Public License for more details.",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "See the GNU Lesser General Public License for more details.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "This software is provided 'as-is', without any express or implied warranty.",
    "In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "Distributed under the Boost Software License, Version 1.0.",
    "To the extent possible under law, {} has waived all copyright and related or neighboring rights to this work.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Copyright {} All rights reserved.",
]
#: Name, licence, sentences in order.
RULES = [
    ("mit-notice", "MIT", [1]), ("mit-text", "MIT", [2, 3, 4]), ("mit-grant", "MIT", [2, 3]),
    ("apache-2.0-notice", "Apache-2.0", [5]), ("apache-2.0-header", "Apache-2.0", [6, 7, 8, 9]), ("apache-2.0-short-header", "Apache-2.0", [6, 7]),
    ("gpl-3.0-notice", "GPL-3.0", [10]), ("gpl-3.0-header", "GPL-3.0-or-later", [11, 13, 14]), ("gpl-3.0-grant", "GPL-3.0-or-later", [11]),
    ("gpl-2.0-header", "GPL-2.0-or-later", [12, 13, 14]), ("gpl-2.0-grant", "GPL-2.0-or-later", [12]),
    ("bsd-3-clause-text", "BSD-3-Clause", [15, 16, 17, 18]), ("bsd-2-clause-text", "BSD-2-Clause", [15, 16, 17]), ("isc-text", "ISC", [19]),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", [20]), ("cc-by-4.0-notice", "CC-BY-4.0", [21]), ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", [22]),
    ("cc-by-nc-4.0-statement", "CC-BY-NC-4.0", [23]), ("cc-by-4.0-statement", "CC-BY-4.0", [24]), ("unlicense-statement", "Unlicense", [25]),
    ("reserved-notice", "All-rights-reserved", [26]), ("mit-full-text", "MIT", [2, 3, 4, 27]), ("mit-0-text", "MIT-0", [49, 4, 27]), ("mit-0-grant", "MIT-0", [49]),
    ("bsd-3-clause-holder-text", "BSD-3-Clause", [15, 16, 17, 28]), ("bsd-3-clause-full-text", "BSD-3-Clause", [15, 16, 17, 18, 29, 30]), ("bsd-3-clause-holder-full-text", "BSD-3-Clause", [15, 16, 17, 28, 29, 30]),
    ("bsd-2-clause-full-text", "BSD-2-Clause", [15, 16, 17, 29, 30]), ("bsd-4-clause-text", "BSD-4-Clause", [15, 16, 17, 31]), ("isc-full-text", "ISC", [19, 32]),
    ("agpl-3.0-header", "AGPL-3.0-or-later", [33, 13, 34]), ("agpl-3.0-grant", "AGPL-3.0-or-later", [33]), ("lgpl-2.1-header", "LGPL-2.1-or-later", [35, 36, 37]), ("lgpl-2.1-grant", "LGPL-2.1-or-later", [35]),
    ("lgpl-3.0-header", "LGPL-3.0-or-later", [38, 13, 37]), ("lgpl-3.0-grant", "LGPL-3.0-or-later", [38]), ("mpl-2.0-header", "MPL-2.0", [39, 40]), ("mpl-2.0-notice", "MPL-2.0", [39]), ("epl-2.0-notice", "EPL-2.0", [41]),
    ("zlib-text", "Zlib", [42, 43, 44]), ("bsl-1.0-text", "BSL-1.0", [45]), ("bsl-1.0-notice", "BSL-1.0", [46]), ("cc0-statement", "CC0-1.0", [47]), ("unlicense-text", "Unlicense", [25, 48]),
    ("cc-by-sa-4.0-the-statement", "CC-BY-SA-4.0", [50]), ("cc-by-sa-4.0-statement", "CC-BY-SA-4.0", [51]), ("cc-by-nd-4.0-statement", "CC-BY-ND-4.0", [52]), ("holder-reserved-notice", "All-rights-reserved", [53]),
]
#: Unknown sentences allowed between two of a rule.
GAP = 2


def normal(sentence: str) -> str:
    """A sentence as it is compared."""
    return re.sub("[^A-Za-z0-9]+", " ", sentence).strip().lower()


def trail(numbers: list[int]) -> str:
    return "".join(f"<{n}>" for n in numbers)


def sentences_of(text: Column) -> Column:
    """Normalised sentences of a text, in order, without empty ones.

    A sentence ends at a line end, or at a full stop, exclamation or question mark, or colon before white space.
    """
    lines = F.regexp_replace(text, r"([.!?:])[ \t\n\f\r\x0B]+", "$1\n")
    plain = F.lower(F.regexp_replace(lines, r"[^A-Za-z0-9\n]+", " "))
    return F.array_remove(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), "")


def parts_of(sentence: str) -> list[str]:
    """A known sentence as it is compared, around its variable parts."""
    return [normal(p) for p in sentence.split("{}")]


def pattern_of(sentence: str, gap: str) -> str:
    """A regular expression of a known sentence whose words stand ``gap`` apart."""
    return f"{gap}(?:[a-z0-9]+{gap}){{1,12}}".join(p.replace(" ", gap) for p in parts_of(sentence))


def numbered(found: Column, known: list[str]) -> Column:
    """The sentences ``found`` with each known one as ``<n>``, whether it is one of them or several in a row.

    Longer known sentences go first, as a line end may leave a shorter one at their beginning.
    """
    longest = [max(parts_of(k), key=len) for k in known]
    order = sorted(range(len(known)), key=lambda n: ("{}" in known[n], -len(normal(known[n])), n))
    table = F.array(*[F.struct(F.lit(longest[n]).alias("said"), F.lit("\n" + pattern_of(known[n], "[ \n]") + "(?=\n)").alias("pattern"), F.lit(f"\n<{n + 1}>").alias("shown")) for n in order])
    # filter's list is taken from the text once, so that most texts meet no pattern at all
    said = F.array_join(found, " ")
    held = F.filter(table, lambda x: F.contains(said, x["said"]))
    lines = F.concat(F.lit("\n"), F.array_join(found, "\n"), F.lit("\n"))
    shown = F.aggregate(held, lines, lambda a, x: F.regexp_replace(a, x["pattern"], x["shown"]))
    return F.array_remove(F.split(shown, "\n"), "")


def licence_scan(df: DataFrame, text: str = "text", key: str = "doc_id", sentences: list[str] | None = None, rules: list | None = None, gap: int = GAP) -> DataFrame:
    """``(key, n_sentences, sentence_ids, rules, licences)`` for every row of ``df``.

    n_sentences counts what marks and line ends cut; a known sentence may take up several of these.
    sentence_ids shows the known sentences in order, ``<n>`` each, with ``|`` where more than
    ``gap`` unknown ones lie between; rules names the matching rules, in rule order, without those
    whose sentences are all part of another matching rule; licences are theirs, sorted, each once.
    Both are joined by commas and empty where nothing matches. Null and empty texts have no
    sentences. All is done within the row: nothing is shuffled, so neither copies nor hot keys
    matter; repeated rows stay, an empty table gives none, other columns are ignored.
    """
    known = SENTENCES if sentences is None else sentences
    rules = RULES if rules is None else rules
    found = df.select(df[key].alias("key"), F.coalesce(sentences_of(df[text]), F.array().cast("array<string>")).alias("all"))
    found = found.select("key", "all", F.when(F.size("all") > 0, numbered(F.col("all"), known)).otherwise(F.col("all")).alias("named"))
    numbers = F.transform("named", lambda s, i: F.struct(F.when(s.startswith("<"), F.substring_index(F.substring(s, 2, 12), ">", 1).cast("int")).alias("n"), i.alias("at")))
    hits = found.select("key", F.size("all").cast("long").alias("n_sentences"), F.filter(numbers, lambda x: x["n"] > 0).alias("hits"))
    shown = F.expr(
        "aggregate(hits, named_struct('last', -1, 'shown', ''), (a, x) -> named_struct('last', x.at, 'shown', "
        f"concat(a.shown, if(a.last >= 0 and x.at - a.last > {gap + 1}, '|', ''), '<', x.n, '>')), a -> a.shown)"
    )
    seen = hits.select("key", "n_sentences", shown.alias("sentence_ids"))
    wider = {name: [trail(o) for n, _, o in rules if n != name and trail(ids) in trail(o)] for name, _, ids in rules}
    matched = F.array_compact(
        F.array(*[F.when(_holds(trail(ids), wider[name]), F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("licence"))) for name, licence, ids in rules])
    )
    named = seen.withColumn("matched", F.when(F.col("sentence_ids") != "", matched))
    return named.select(
        F.col("key").alias(key), "n_sentences", "sentence_ids", F.coalesce(F.concat_ws(",", "matched.rule"), F.lit("")).alias("rules"),
        F.coalesce(F.concat_ws(",", F.array_sort(F.array_distinct("matched.licence"))), F.lit("")).alias("licences"),
    )


def _holds(part: str, wider: list[str]) -> Column:
    """Whether the trail occurs, other than only as part of wider rules that occur too."""
    shown = F.col("sentence_ids")
    out = F.contains(shown, F.lit(part))
    for other in wider:
        out = out & ~F.contains(shown, F.lit(other))
    return out


def oracle() -> str:
    """DuckDB SQL for ``licence_scan`` of documents."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({i}, {quoted(normal(s))})" for i, s in enumerate(SENTENCES, 1) if "{}" not in s)
    varied = ", ".join(f"({i}, {quoted(pattern_of(s, ' '))})" for i, s in enumerate(SENTENCES, 1) if "{}" in s)
    cases = []
    for place, (name, licence, ids) in enumerate(RULES):
        wider = [trail(o) for n, _, o in RULES if n != name and trail(ids) in trail(o)]
        cases.append(f"({place}, '{name}', '{licence}', '{trail(ids)}', [{', '.join(map(quoted, wider))}]::VARCHAR[])")
    return f"""
with known(n, sentence) as (values {known}),
varied(n, pattern) as (values {varied}),
rules(place, rule, licence, ids, wider) as (values {", ".join(cases)}),
cut as (select doc_id, list_filter(list_transform(string_split(lower(regexp_replace(regexp_replace(text, '([.!?:])[ \\t\\n\\f\\r\\x0B]+', '\\1' || chr(10), 'g'), '[^A-Za-z0-9' || chr(10) || ']+', ' ', 'g')), chr(10)), lambda x: trim(x)), lambda x: x <> '') as found from documents),
said as (select doc_id, unnest(found) as sentence, generate_subscripts(found, 1) as pos from cut),
hits as (select doc_id, n, pos, pos - lag(pos) over (partition by doc_id order by pos) as step from (select doc_id, n, pos from said join known using (sentence) union all select doc_id, n, pos from said join varied on regexp_full_match(sentence, pattern) where sentence not in (select sentence from known))),
shown as (select doc_id, string_agg(case when step > {GAP + 1} then '|' else '' end || '<' || n || '>', '' order by pos) as sentence_ids from hits group by doc_id),
matched as (select doc_id, string_agg(rule, ',' order by place) as rules, string_agg(distinct licence, ',' order by licence) as licences
  from shown join rules on contains(sentence_ids, ids) and len(list_filter(wider, lambda w: contains(sentence_ids, w))) = 0 group by doc_id)
select doc_id, coalesce(len(found), 0)::BIGINT as n_sentences, coalesce(sentence_ids, '') as sentence_ids, coalesce(rules, '') as rules, coalesce(licences, '') as licences
from cut left join shown using (doc_id) left join matched using (doc_id)"""
