"""Licence scans by sentence-rule recognition, in SQL functions only.

Texts are cut at sentence ends, colons and line ends, normalised, and runs of pieces looked up in a table
of known licence sentences. The identifiers found in a document, in order, are matched against ordered rules, each a
sequence of identifiers that must follow each other with no other known sentence between. Where rules overlap the
first counts, then the one of most sentences: a licence's whole text outranks its parts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Known licence sentences, normalised (lower case, runs of other characters than letters and digits as one space).
# A star is a slot, as for a holder's or a project's name: one to eight words.
SENTENCES = {
    "mit-name": "released under the mit license",
    "mit-name-2": "licensed under the mit license",
    "mit-name-3": "this project is licensed under the mit license",
    "mit-name-4": "distributed under the terms of the mit license",
    "mit-name-5": "released under the mit license by *",
    "mit-name-6": "* is released under the mit license",
    "mit-head": "mit license",
    "mit-head-2": "the mit license",
    "mit-head-3": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-head": "isc license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache-name": "licensed under the apache license version 2 0",
    "apache-name-2": "licensed under the apache license version 2 0 the license",
    "apache-name-3": "this project is licensed under the apache license version 2 0",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-head": "apache license version 2 0 january 2004",
    "apache-terms": "terms and conditions for use reproduction and distribution",
    "gpl2-name": "this work is licensed under the gnu general public license version 2",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "gpl2-head": "gnu general public license version 2 june 1991",
    "gpl3-head": "gnu general public license version 3 29 june 2007",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "gpl2-only-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl2-head": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-head": "gnu lesser general public license version 3 29 june 2007",
    "lgpl2-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl3-head": "gnu affero general public license version 3 19 november 2007",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd-name": "licensed under the bsd license",
    "bsd2-head": "bsd 2 clause license",
    "bsd3-head": "bsd 3 clause license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "mpl-head": "mozilla public license version 2 0",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "epl2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-use": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-head": "boost software license version 1 0 august 17th 2003",
    "boost-name": "distributed under the boost software license version 1 0",
    "cc0-head": "cc0 1 0 universal",
    "cc0-name": "licensed under cc0 1 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "all-rights": "all rights reserved",
}

# The ordered rules, licence to sequences of sentence identifiers.
RULES = {
    "MIT": [["mit-name"], ["mit-name-2"], ["mit-name-3"], ["mit-name-4"], ["mit-name-5"], ["mit-name-6"], ["mit-grant", "mit-notice"], ["mit-head", "mit-grant"], ["mit-head-2", "mit-grant"], ["mit-head-3", "mit-grant"], ["mit-grant", "mit-notice", "as-is"], ["mit-grant", "mit-notice", "as-is", "mit-liable"]],
    "ISC": [["isc-grant"], ["isc-grant-2"], ["isc-grant", "isc-as-is"], ["isc-grant-2", "isc-as-is"], ["isc-head", "isc-grant", "isc-as-is"]],
    "Apache-2.0": [["apache-name"], ["apache-name-2"], ["apache-name-3"], ["apache-use", "apache-copy"], ["apache-name-2", "apache-use", "apache-copy", "apache-url", "apache-unless", "apache-see"], ["apache-head"], ["apache-head", "apache-terms"], ["apache-head", "apache-url", "apache-terms"]],
    "GPL-2.0": [["gpl2-name"], ["gpl2-head"], ["gpl2-free"], ["gpl2-free", "gpl-hope"], ["gpl2-only"], ["gpl2-only", "gpl-hope"], ["gpl2-only-2"], ["gpl2-only-2", "gpl-hope"]],
    "GPL-3.0": [["gpl3-name"], ["gpl3-head"], ["gpl-free"], ["gpl-free", "gpl-hope"]],
    "LGPL-2.1": [["lgpl2-head"], ["lgpl2-free"], ["lgpl2-free", "lgpl-hope"]],
    "LGPL-3.0": [["lgpl3-head"], ["lgpl3-free"], ["lgpl3-free", "lgpl-hope"]],
    "AGPL-3.0": [["agpl3-head"], ["agpl3-free"], ["agpl3-free", "gpl-hope"]],
    "BSD": [["bsd-name"], ["bsd-grant"]],
    "BSD-2-Clause": [["bsd2-head"], ["bsd-grant", "bsd-source", "bsd-binary"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]],
    "BSD-3-Clause": [["bsd3-head"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]],
    "MPL-2.0": [["mpl-head"], ["mpl-form"], ["mpl-form", "mpl-copy"], ["mpl-form", "mpl-copy-2"]],
    "EPL-2.0": [["epl2"]],
    "Unlicense": [["unlicense"], ["unlicense", "unlicense-use"]],
    "Zlib": [["zlib-grant"], ["zlib-as-is", "zlib-liable", "zlib-grant"]],
    "BSL-1.0": [["boost-head"], ["boost-name"]],
    "CC0-1.0": [["cc0-head"], ["cc0-name"]],
    "CC-BY-NC-4.0": [["cc-by-nc"], ["cc-by-nc-long"]],
    "CC-BY-4.0": [["cc-by"], ["cc-by-long"]],
    "CC-BY-SA-4.0": [["cc-by-sa"], ["cc-by-sa-long"]],
}
# Every licence's machine-readable line is a known sentence and a rule of its own.
for _name, _rules in RULES.items():
    for _suffix in ("", "-only", "-or-later") if "GPL" in _name else ("",):
        SENTENCES[f"spdx-{_name}{_suffix}".lower()] = re.sub("[^a-z0-9]+", " ", f"spdx license identifier {_name}{_suffix}".lower())
        _rules.append([f"spdx-{_name}{_suffix}".lower()])

SLOT_WORDS = 8
# Markup around a sentence ends it, as a line does.
TAG = r"</?[A-Za-z][^<>\n]{0,200}>"
BREAK = rf"[.!?;](?=\s|$)|\n+|{TAG}"
# A known sentence may also end or begin at a colon that no small letter follows; it does not count as a place.
COLON = r":(?=\s+[^\s\p{Ll}]|\s*$)"
# Every known sentence has one of these; texts without are not cut.
CUE = r"licen[cs]e|permission|copyright|warranty|redistribut|rights[^\p{L}\p{N}]+reserved|reproduction|warranties|unencumbered|compiled|liable|accompanying|mpl|cc0"
# Places are written into the words between these two.
OPEN, CLOSE = "\x01", "\x02"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def words_pattern(words: str, gap: str, word: str) -> str:
    """A known sentence as a pattern, with gap between its words and one to eight words in a slot."""
    slot = f"{word}(?:{gap}{word}){{0,{SLOT_WORDS - 1}}}"
    return gap.join(slot if w == "*" else w for w in words.split(" "))


def _known_pattern() -> str:
    """A known sentence from a break to a break, the longest first; between its words there may be breaks, as texts are wrapped."""
    place = rf"{OPEN}\d+{CLOSE}"
    ways = "|".join(words_pattern(words, f"(?: |{place})", f"[^ {OPEN}{CLOSE}]++") for words in sorted(SENTENCES.values(), key=len, reverse=True))
    return f"{place}(?:{ways})(?={OPEN}|$)"


def sentence_of(words: Column) -> Column:
    """The identifier of a sentence with a slot that the words are; NULL if they are none."""
    slotted = [F.when(words.rlike(f"^{words_pattern(known, ' ', '[^ ]++')}$"), F.lit(k)) for k, known in SENTENCES.items() if "*" in known]
    return F.coalesce(*slotted)


def ranked_rules() -> dict[str, str]:
    """The rules as texts <identifier><identifier>..., those of most sentences first, each with its licence."""
    every = [(len(rule), name, "".join(f"<{s}>" for s in rule)) for name, rules in RULES.items() for rule in rules]
    return {rule: name for _, name, rule in sorted(every, key=lambda r: (-r[0], r[1], r[2]))}


def known_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, place, sentence) of every licence sentence in a document; place is the number of the piece between breaks that it begins in.

    A sentence may be wrapped over any number of lines. Of overlapping ones the first, then the longest counts.
    """
    spark = documents.sparkSession
    table = spark.createDataFrame([(k, v) for k, v in SENTENCES.items()], "sentence string, words string")
    cue = F.coalesce(F.lower("text").rlike(CUE), F.lit(False))
    numbered = F.transform(F.split(F.when(cue, F.col("text")), BREAK, -1), lambda x, i: F.transform(F.split(x, COLON, -1), lambda y: F.struct(i.alias("place"), normalised(y).alias("words"))))
    pieces = F.filter(F.flatten(numbered), lambda x: x["words"] != "")
    marked = F.array_join(F.transform(pieces, lambda x: F.concat(F.lit(OPEN), x["place"].cast("string"), F.lit(CLOSE), x["words"])), "")
    found = documents.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.regexp_extract_all(marked, F.lit(_known_pattern()), F.lit(0))).alias("m"))
    place = F.regexp_extract("m", rf"^{OPEN}(\d+){CLOSE}", 1).cast("int")
    words = F.trim(F.regexp_replace("m", rf"{OPEN}\d+{CLOSE}", " "))
    found = found.select("doc_id", "text_key", place.alias("place"), words.alias("words"))
    named = found.join(F.broadcast(table), "words", "left")
    return named.select("doc_id", "text_key", "place", F.coalesce("sentence", sentence_of(F.col("words"))).alias("sentence"))


def scan_licenses(documents: DataFrame) -> DataFrame:
    """(doc_id, licenses, sentences, n_sentences, first_place, last_place) of every document with a known licence sentence.

    licenses are the licences of the matched rules, sorted and comma-joined ("" if sentences match no rule);
    sentences the identifiers in order. Null and empty texts have none. Rows with the same doc_id and text
    give one row; null ids pass through. Other columns are ignored; an empty table gives an empty result.
    """
    found = known_sentences(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).distinct()
    per = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("s"))
    sequence = F.array_join(F.transform("s", lambda x: x["sentence"]), " ")
    per = per.select("doc_id", sequence.alias("sentences"), F.size("s").cast("long").alias("n_sentences"), F.array_min(F.transform("s", lambda x: x["place"])).cast("long").alias("first_place"), F.array_max(F.transform("s", lambda x: x["place"])).cast("long").alias("last_place"))
    ranked = ranked_rules()
    names = F.create_map(*[F.lit(x) for pair in ranked.items() for x in pair])
    tagged = F.concat(F.lit("<"), F.replace("sentences", F.lit(" "), F.lit("><")), F.lit(">"))
    matched = F.transform(F.regexp_extract_all(tagged, F.lit("|".join(ranked)), F.lit(0)), lambda rule: F.element_at(names, rule))
    return per.select("doc_id", F.array_join(F.array_sort(F.array_distinct(matched)), ",").alias("licenses"), "sentences", "n_sentences", "first_place", "last_place")
