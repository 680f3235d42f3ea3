"""License scan in DataFrame functions alone: ordered signature rules over the words of each text.

A text's words are brought to one normal form (lower case, one space between words). A cheap test for a few words, of
which each rule has one, gates the work; each rule has a keyword of its own that must stand in the text before its regex is tried.
Detections are word intervals. One that lies within another is dropped; of equal intervals the one of the rule
with the smaller priority number stays; of those that overlap in part one goes if a better one, by priority, then length, then
place, overlaps it. The work grows in proportion to the text for each rule whose keyword it holds.
All of it happens inside the row, so nothing is shuffled and no key can be hot.

Null and empty texts have no words and no labels. Repeated rows give repeated results. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks put around matches; no word holds them.
BEGIN, END = "\x01", "\x02"
#: What stands between words once A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, keyword, names as regex, versions). Rules are the product of names, versions and TEMPLATES.
FAMILIES = (
    ("mit", "mit", "mit", ("",)),
    ("mit", "expat", "expat", ("",)),
    ("mit", "x11", "x11", ("",)),
    ("apache", "apache", "apache(?: software)?", ("1 0", "1 1", "2 0", "2")),
    ("gpl", "gpl", "gnu gpl|gpl", ("1", "2", "3", "2 0", "3 0")),
    ("gpl", "general public", "(?:gnu )?general public", ("1", "2", "3")),
    ("lgpl", "lgpl", "gnu lgpl|lgpl", ("2", "2 1", "3")),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public", ("2", "2 1", "3")),
    ("lgpl", "library general", "(?:gnu )?library general public", ("2",)),
    ("agpl", "agpl", "gnu agpl|agpl", ("1", "3")),
    ("agpl", "affero", "(?:gnu )?affero general public", ("1", "3")),
    ("bsd", "bsd", "bsd(?: (?:0|1|2|3|4|two|three|four) clause)?|(?:simplified|new|modified|revised) bsd", ("",)),
    ("mpl", "mozilla", "mozilla public", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 1", "2 0")),
    ("epl", "eclipse", "eclipse (?:public|distribution)", ("1 0", "2 0")),
    ("cddl", "common development", "common development and distribution", ("1 0", "1 1")),
    ("cpl", "common public", "common public", ("1 0",)),
    ("isc", "isc", "isc", ("",)),
    ("artistic", "artistic", "(?:clarified )?artistic", ("1 0", "2 0")),
    ("boost", "boost", "boost(?: software)?", ("1 0",)),
    ("zlib", "zlib", "zlib(?: libpng)?", ("",)),
    ("unlicense", "unlicense", "unlicense", ("",)),
    ("wtfpl", "wtfpl", "wtfpl", ("2",)),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc-by", "creative commons attribution", "creative commons attribution", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("ofl", "open font", "(?:sil )?open font", ("1 0", "1 1")),
    ("eupl", "european union", "european union public", ("1 0", "1 1", "1 2")),
    ("osl", "open software", "open software", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("python", "python software", "python software foundation", ("2",)),
    ("php", "php", "php", ("3 0", "3 01")),
    ("postgresql", "postgresql", "postgresql", ("",)),
    ("openssl", "openssl", "openssl", ("",)),
    ("ms-pl", "microsoft public", "microsoft public", ("",)),
)
#: (priority, confidence, template); $N is the family's names, $V its version.
TEMPLATES = (
    (10, 1.0, "spdx license identifier (?:$N)(?: $V)?(?: only| or later)?"),
    (20, 0.95, "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:$N) licen[sc]e(?: (?:version |v)?$V)?"),
    (30, 0.9, "(?:$N) licen[sc]e (?:version |v)?$V"),
    (40, 0.8, "(?:the )?(?:$N) licen[sc]e"),
)
#: Signature sentences: (label, priority, confidence, keyword, regex).
SENTENCES = (
    ("mit", 5, 1.0, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 6, 0.9, "above copyright notice", "the above copyright notice and this permission notice shall be included"),
    ("isc", 5, 1.0, "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 5, 1.0, "redistribution and use", "redistribution and use in source and binary forms"),
    ("gpl", 5, 1.0, "free software", "this program is free software you can redistribute it and or modify it"),
    ("apache", 5, 1.0, "apache org licenses", "(?:http|https) www apache org licenses(?: license 2 0)?"),
    ("copyright", 50, 0.5, "all rights reserved", "all rights reserved"),
    ("copyright", 60, 0.4, "copyright", "copyright (?:c )?[0-9]{4}(?: [0-9]{4})?"),
    ("proprietary", 50, 0.6, "proprietary", "proprietary and confidential|confidential and proprietary"),
    ("public-domain", 50, 0.6, "public domain", "(?:released |placed )?(?:in|into|to) the public domain"),
)
#: Further sentences by license, written by hand from the license texts; the words before the first group are the keyword.
SIGNATURES = {
    "mit": ("to deal in the software without restriction", "the software is provided as is without warranty of any kind express or implied", "in no event shall the authors or copyright holders be liable for any claim"),
    "apache": (
        "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license",
        "see the license for the specific language governing permissions and limitations", "terms and conditions for use reproduction and distribution",
        "each contributor hereby grants to you a perpetual worldwide non exclusive", "this product includes software developed by the apache (?:group|software foundation)", "licensed to the apache software foundation asf",
    ),
    "gpl": (
        "either version (?:2|3)(?: 0)? of the license or(?: at your option)? any later version", "this program is distributed in the hope that it will be useful",
        "you should have received a copy of the gnu general public license", "the gnu general public license is a free copyleft license", "www gnu org licenses gpl",
    ),
    "lgpl": ("this library is free software you can redistribute it and or modify it", "you should have received a copy of the gnu (?:lesser|library) general public license", "a program that contains no derivative of any portion of the library but is designed to work with the library", "www gnu org licenses lgpl"),
    "agpl": ("you should have received a copy of the gnu affero general public license", "if your software can interact with users remotely through a computer network", "www gnu org licenses agpl"),
    "gfdl": ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    "bsd": (
        "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice",
        "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors", "all advertising materials mentioning features or use of this software must display", "this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is",
    ),
    "isc": ("the software is provided as is and the author disclaims all warranties", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    "hpnd": ("permission to use copy modify distribute and sell this software and its documentation for any purpose", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license", "the contents of this file are subject to the mozilla public license", "incompatible with secondary licenses", "mozilla org mpl"),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse", "the accompanying program is provided under the terms of this eclipse public license", "www eclipse org legal epl"),
    "cddl": ("the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license cddl"),
    "cpl": ("the accompanying program is provided under the terms of this common public license", "ibm public license"),
    "zlib": ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such", "this software is provided as is without any express or implied warranty"),
    "boost": ("permission is hereby granted free of charge to any person or organization obtaining a copy", "www boost org license 1 0 txt"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"),
    "wtfpl": ("do what the fuck you want to public licen[sc]e", "you just do what the fuck you want to"),
    "cc0": ("the person who associated a work with this deed has dedicated the work to the public domain", "creativecommons org publicdomain zero", "cc0 1 0 universal"),
    "cc-by": ("creativecommons org licenses by [0-9] [0-9]", "this work is licensed under a creative commons attribution [0-9] [0-9]"),
    "cc-by-sa": ("creativecommons org licenses by sa", "cc by sa"),
    "cc-by-nc": ("creativecommons org licenses by nc [0-9]", "cc by nc [0-9]"),
    "cc-by-nd": ("creativecommons org licenses by nd", "cc by nd"),
    "cc-by-nc-sa": ("creativecommons org licenses by nc sa", "cc by nc sa"),
    "cc-by-nc-nd": ("creativecommons org licenses by nc nd", "cc by nc nd"),
    "odbl": ("open database license", "opendatacommons org licenses odbl"),
    "odc-by": ("open data commons attribution license", "opendatacommons org licenses by"),
    "ofl": ("this font software is licensed under the sil open font license", "the font software may not be sold by itself", "scripts sil org ofl"),
    "eupl": ("licensed under the eupl", "european union public licence"),
    "artistic": ("the intent of this document is to state the conditions under which a package may be copied", "this package is free software you can redistribute it under the same terms as perl"),
    "python": ("psf license agreement for python", "psf is making python available to licensee on an as is basis"),
    "php": ("this product includes php software freely available from", "the name php must not be used to endorse or promote"),
    "postgresql": ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement",),
    "openssl": ("this product includes software developed by the openssl project", "this product includes cryptographic software written by eric young"),
    "ncsa": ("university of illinois ncsa open source license",),
    "w3c": ("w3c software notice and license", "w3c software and document"),
    "ms-pl": ("microsoft limited public license",),
    "ms-rl": ("microsoft reciprocal license",),
    "ruby": ("you may make and give away verbatim copies of the source form of the software without restriction",),
    "sspl": ("server side public license",),
    "busl": ("business source license", "the change license is"),
    "elastic": ("elastic license",),
    "commons-clause": ("commons clause license condition",),
    "json": ("the software shall be used for good not evil",),
    "beerware": ("the beer ware license", "as long as you retain this notice you can do whatever you want with this stuff"),
    "freetype": ("the freetype project license", "portions of this software are copyright (?:[^ ]+ ){0,4}the freetype project"),
    "ijg": ("this software is based in part on the work of the independent jpeg group",),
    "unicode": ("unicode license agreement data files and software",),
    "lppl": ("latex project public license", "this work has the lppl maintenance status"),
    "qpl": ("the q public license",),
    "zope": ("zope public license",),
    "sleepycat": ("redistributions in any form must be accompanied by information on how to obtain complete source code",),
    "cecill": ("licence de logiciel libre cecill", "cecill free software license"),
    "mulan": ("mulan permissive software license",),
    "openldap": ("openldap public license",),
    "upl": ("universal permissive license",),
    "ecl": ("educational community license",),
    "proprietary": (
        "unauthorized copying of this file", "this software is the confidential and proprietary information of", "you shall not disclose such confidential information",
        "may not be reproduced or distributed without (?:the |our )?(?:prior |express )?written (?:permission|consent)", "end user license agreement", "for evaluation purposes only", "this software contains trade secrets",
    ),
}


#: Words of further license texts and notices, by license.
NOTICES = {
    "mit": ("free of charge to any person obtaining a copy of this software and associated documentation files", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", "opensource org licenses mit"),
    "mit-0": ("mit no attribution", "mit 0 license"),
    "apache": ("apache license version 2 0 january 2004", "derivative works shall mean any work whether in source or object form", "this product includes software developed at the apache software foundation", "subject to the terms and conditions of this license each contributor hereby grants"),
    "gpl": (
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "when we speak of free software we are referring to freedom not price", "the licenses for most software are designed to take away your freedom",
        "this program comes with absolutely no warranty", "linking this (?:library|program) statically or dynamically with other modules", "you may convey verbatim copies of the program s source code as you receive it", "gnu general public license for more details",
    ),
    "gpl-exception": ("as a special exception the copyright holders of this (?:library|program) give you permission to link", "gcc runtime library exception", "classpath exception", "as a special exception to the gnu general public license", "autoconf configure script exception", "bison exception"),
    "lgpl": ("this license the lesser general public license applies to some specially designated software packages", "the precise terms and conditions for copying distribution and modification follow", "gnu lesser general public license for more details"),
    "agpl": ("notwithstanding any other provision of this license if you modify the program your modified version must prominently offer all users", "gnu affero general public license for more details"),
    "gfdl": ("with no invariant sections no front cover texts and no back cover texts", "the purpose of this license is to make a manual textbook or other functional and useful document free"),
    "bsd": (
        "the name of the author may not be used to endorse or promote products derived from this software", "in no event shall the (?:copyright (?:owner|holder)|regents|author)(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages",
        "even if advised of the possibility of such damage", "redistributions of source code must retain the copyright notice", "subject to the limitations in the disclaimer below", "opensource org licenses bsd",
    ),
    "bsd-0": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "mpl": ("mozilla public license version (?:1|2) [01]", "software distributed under the license is distributed on an as is basis without warranty of any kind", "covered software is provided under this license on an as is basis"),
    "epl": ("eclipse distribution license", "secondary licenses when the conditions for such availability set forth in the eclipse public license", "each contributor hereby grants recipient a non exclusive worldwide royalty free copyright license"),
    "cddl": ("this software may be used under the terms of the common development and distribution license", "when distributing covered code include this cddl header"),
    "zlib": ("permission is granted to anyone to use this software for any purpose including commercial applications", "this notice may not be removed or altered from any source distribution"),
    "boost": ("copies of the software in whole or in part and all derivative works of the software unless such copies", "boost software license"),
    "cc0": ("to the extent possible under law (?:[^ ]+ ){1,8}has waived all copyright", "no rights reserved"),
    "cc-by": ("you must give appropriate credit provide a link to the license and indicate if changes were made", "creative commons attribution license"),
    "cc-by-sa": ("if you remix transform or build upon the material you must distribute your contributions under the same license", "creative commons attribution share alike"),
    "cc-by-nc": ("you may not use the material for commercial purposes", "creative commons attribution non commercial"),
    "cc-by-nd": ("if you remix transform or build upon the material you may not distribute the modified material", "creative commons attribution no derivatives"),
    "public-domain": ("this work is in the public domain", "dedicated to the public domain", "no copyright is claimed", "the author disclaims copyright to this source code"),
    "odbl": ("this database is made available under the open database license", "any rights in individual contents of the database are licensed under the database contents license"),
    "ofl": ("with reserved font name", "this license is copied below and is also available with a faq"),
    "eupl": ("you may not use this work except in compliance with the licence", "european union public license"),
    "artistic": ("the artistic license", "everyone is permitted to copy and distribute verbatim copies of this license document", "the clarified artistic license"),
    "python": ("python software foundation license", "beopen python open source license agreement", "cnri hereby grants licensee a nonexclusive royalty free world wide license"),
    "openssl": ("redistributions of any form whatsoever must retain the following acknowledgment", "original ssleay license"),
    "ms-pl": ("microsoft public license",),
    "ms-rl": ("for any file you distribute that contains code from the software you must provide recipients the source code to that file",),
    "ruby": ("ruby is copyrighted free software by yukihiro matsumoto",),
    "sspl": ("if you make the functionality of the program or a modified version available to third parties as a service",),
    "busl": ("the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "additional use grant"),
    "elastic": ("you may not provide the software to third parties as a hosted or managed service",),
    "polyform": ("polyform (?:noncommercial|small business|shield|strict|perimeter) license",),
    "hippocratic": ("hippocratic license",),
    "llama": ("community license agreement", "acceptable use policy"),
    "openrail": ("responsible ai license", "creativeml open rail m", "use based restrictions"),
    "vim": ("vim is charityware",),
    "info-zip": ("info zip license",),
    "tcl": ("the authors hereby grant permission to use copy modify distribute and license this software and its documentation",),
    "icu": ("icu license",),
    "libpng": ("the png reference library is supplied as is", "libpng license"),
    "curl": ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "afl": ("academic free license",),
    "osl": ("open software license",),
    "rpl": ("reciprocal public license",),
    "ipl": ("ibm public license version 1 0",),
    "apsl": ("apple public source license", "apple open source license"),
    "npl": ("netscape public license",),
    "sissl": ("sun industry standards source license",),
    "proprietary": (
        "all rights are reserved by the (?:author|publisher|copyright holder)", "strictly confidential", "no part of this (?:publication|book|document|work) may be reproduced", "trade secret and confidential information", "licensed material property of",
        "use duplication or disclosure by the government is subject to restrictions", "by installing or using (?:the|this) software you agree to be bound", "this software is licensed not sold", "reverse engineer decompile or disassemble the software", "for internal use only",
    ),
}


def keyword_of(regex: str) -> str:
    """The words that stand plainly at the start of a regex."""
    plain = regex[: min((regex.find(c) for c in "([{?*+|\\" if c in regex), default=len(regex))]
    return plain.rstrip() if plain == regex or plain.endswith(" ") else plain


def heads(keywords: list[str]) -> tuple[list[str], list[str]]:
    """A few long words, chosen greedily, and the keywords that have none of five letters: each keyword holds one of either."""
    long = lambda k: {w for w in k.split() if len(w) >= 5}
    chosen, left = [], sorted(k for k in set(keywords) if long(k))
    while left:
        words = set().union(*map(long, left))
        best = max(words, key=lambda w: (sum(w in k for k in left), len(w), w))
        chosen.append(best)
        left = [k for k in left if best not in k]
    return chosen, sorted(k for k in set(keywords) if not long(k))


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, confidence, keyword, regex), most specific first; a few hundred in all."""
    by_hand = [(label, x) for written in (SIGNATURES, NOTICES) for label, own in written.items() for x in own]
    made = [*SENTENCES, *((label, 7, 0.9, keyword_of(x), x) for label, x in by_hand)]
    for (label, keyword, names, versions), (priority, confidence, template) in product(FAMILIES, TEMPLATES):
        for v in versions if "$V" in template else ("",):
            if not v and "$V" in template:
                template_v = template.replace("(?: $V)?", "").replace("(?: (?:version |v)?$V)?", "")
                if "$V" in template_v:
                    continue
            else:
                template_v = template.replace("$V", v)
            made.append((label, priority, confidence, keyword, template_v.replace("$N", names)))
    return sorted(dict.fromkeys(made), key=lambda r: (r[1], r[0], r[4]))


def _intervals(norm: Column, rule: Column) -> Column:
    """Word intervals (start, stop, and what the rule says) of every match of one rule in ' w0 w1 ... '.

    Each match is marked where it begins and ends, and the marks are read off the words: one pass, however many there are."""
    # a match takes the space before it and leaves the one after it, so that word edges hold and matches may touch
    pattern = F.concat(F.lit(" ("), rule["regex"], F.lit(")(?= )"))
    marked = F.regexp_replace(norm, pattern, F.lit(f" {BEGIN}$1{END}"))

    def spans(words: Column) -> Column:
        places = lambda has: F.filter(F.transform(words, lambda w, i: F.when(has(w), i)), lambda i: i.isNotNull())
        starts, stops = places(lambda w: w.startswith(BEGIN)), places(lambda w: w.endswith(END))
        return F.transform(F.arrays_zip(starts.alias("a"), stops.alias("z")), interval)

    # the first word is number 1 of the split, as the text begins with a space
    interval = lambda s: F.struct(
        (s["a"] - 1).alias("start"), (-s["z"]).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence")
    )
    return F.when(F.rlike(norm, pattern), F.transform(F.array(F.split(marked, " ")), spans)[0])


def _resolved(found: Column) -> Column:
    """What stays of overlapping intervals. One that lies within another goes; of equal ones that with the smaller priority
    number (then label) stays. Of those left, one goes that overlaps a better one: of smaller priority number, else longer,
    else earlier.

    In order of start, longest, priority, the first of each start holds the others of that start. As starts differ then, an
    interval that holds or overlaps one is fewer places away than the longest has words. Elements are looked up by
    place; a fold would copy its array at each step, a slice go through the whole of it."""
    stop = lambda x: -x["back"]

    def firsts(rows: Column) -> Column:
        return F.filter(rows, lambda x, k: ~F.coalesce(F.get(rows, k - 1)["start"] == x["start"], F.lit(False)))

    def outer(rows: Column) -> Column:
        held = lambda x, k, back: F.exists(back, lambda d: F.coalesce(stop(F.get(rows, k - d)) >= stop(x), F.lit(False)))
        return _each_size(rows, lambda n: F.filter(rows, lambda x, k: ~held(x, k, _upto(n - 1))))

    def best(rows: Column) -> Column:
        meets = lambda o, x: F.coalesce((o["start"] < stop(x)) & (x["start"] < stop(o)), F.lit(False))
        rank = lambda i: F.struct(i["priority"], i["start"] + i["back"], i["start"])
        beats = lambda o, x: meets(o, x) & (rank(o) < rank(x))
        beaten = lambda x, k, n: F.exists(_upto(n - 1), lambda d: beats(F.get(rows, k - d), x) | beats(F.get(rows, k + d), x))
        alone = lambda x, k: ~meets(F.get(rows, k - 1), x) & ~meets(F.get(rows, k + 1), x)
        return _each_size(rows, lambda n: F.filter(rows, lambda x, k: alone(x, k) | ~beaten(x, k, n)))

    once = lambda value, use: F.transform(F.array(value), use)[0]
    return once(F.array_sort(found), lambda rows: once(firsts(rows), lambda rows: once(outer(rows), best)))


def _each_size(rows: Column, use) -> Column:
    """use(number of words of the longest interval); no rows give no rows."""
    return F.when(F.size(rows) > 0, F.transform(F.array(F.array_max(F.transform(rows, lambda x: -x["back"] - x["start"]))), use)[0]).otherwise(rows)


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))


def _rule_array(rows: list[tuple]) -> Column:
    """One foldable literal, so that the plan stays small however many rules there are."""
    names = ("label", "priority", "confidence", "keyword", "regex")
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return F.from_json(F.lit(text), "array<struct<label:string,priority:int,confidence:double,keyword:string,regex:string>>")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (places of base phrases), base_labels, detections (start, stop, label, confidence), labels, score.

    labels holds the base labels and the method's, distinct and sorted. score is the largest confidence among the
    detections that stay, 0 without any; a base place counts 0.8.
    """
    every = rules()
    rule_array = _rule_array(every)
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # every rule made from a family has the word license
    words, phrases = heads([r[3] for r in every if r[1] not in {t[0] for t in TEMPLATES}] + ["licen"])
    low = F.lower("text")
    any_head = reduce(or_, [*(F.contains(low, F.lit(h)) for h in words), *(low.rlike(BETWEEN.join(p.split())) for p in phrases)])
    # split is many times faster than regexp_count; as letters are not lowered yet, A-Z belong to words here
    n_words = F.size(F.array_remove(F.split("text", BETWEEN.replace("\\x60", "\\x40\\x5B-\\x60")), ""))
    counted = text.select("doc_id", n_words.cast("long").alias("n_words"), F.when(any_head, F.translate("text", upper, lower)).alias("low"))
    norm = F.concat(F.lit(" "), F.array_join(F.array_remove(F.split("low", BETWEEN), ""), " "), F.lit(" "))

    base_rules = _rule_array([(label, 0, 0.8, phrase, phrase) for phrase, label in BASE])
    empty = F.expr("cast(array() as array<struct<start:int,back:int,priority:int,label:string,confidence:double>>)")

    def detect(text: Column, over: Column) -> Column:
        tried = F.filter(over, lambda r: text.contains(r["keyword"]))
        return F.coalesce(F.flatten(F.filter(F.transform(tried, lambda r: _intervals(text, r)), lambda x: x.isNotNull())), empty)

    # the normal form is a lambda's argument, so that it is made once and not again for each rule
    both = F.transform(F.array(norm), lambda n: F.struct(detect(n, base_rules).alias("base"), _resolved(detect(n, rule_array)).alias("kept")))[0]
    found = counted.withColumn("both", F.when(F.col("low").isNotNull(), both)).drop("low")
    found = found.select("doc_id", "n_words", F.coalesce("both.base", empty).alias("base"), F.coalesce("both.kept", empty).alias("kept"))
    base_labels = F.transform("base", lambda x: x["label"])
    own = F.transform("kept", lambda x: x["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.transform("base", lambda x: x["start"].cast("long")).alias("base"),
        F.array_sort(F.array_distinct(base_labels)).alias("base_labels"),
        F.transform("kept", lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("stop"), x["label"].alias("label"), x["confidence"].alias("confidence"))).alias("detections"),
        F.array_sort(F.array_distinct(F.concat(base_labels, own))).alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(F.transform("kept", lambda x: x["confidence"])), F.lit(0.0)),
            F.when(F.size("base") > 0, 0.8).otherwise(0.0),
        ).alias("score"),
    )
