"""License scans by ordered signature rules, in DataFrame functions only.

A rule is a regular expression over the words of a text, gated by keywords that the text
must all hold, with a label, a priority and a weight. Texts without any keyword run no rule.
Detections that lie inside one of a higher priority, or inside a longer one of the same (of
two of the same place and priority the second by label), are suppressed. The base phrases
are never suppressed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import let, running

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: \p{Alnum} is ASCII here; with A-Z folded these are the contract's words and what parts them.
WORD = r"[\p{Alnum}\x{80}-\x{10FFFF}]++"
NOT_WORD = r"[^\p{Alnum}\x{80}-\x{10FFFF}]++"

#: Fixed by the contract: phrase and label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Priorities: a bare name, a name that something introduces, wording of a license, a name with its version, an identifier.
NAME, LED, BODY, VERSION, IDENTIFIER = 1, 2, 3, 4, 5
WEIGHTS = {NAME: 0.4, LED: 0.8, BODY: 0.9, VERSION: 0.9, IDENTIFIER: 0.95}

#: Signatures by label and priority. Words are separated by spaces, a|b are alternatives for a word, [..] may be missing.
SIGNATURES = """
gpl 1: general public license
gpl 1: [gnu] gpl
gpl 2: licensed|released|distributed|available|covered|provided under|by [the] [terms] [of] [the] [gnu] gpl
gpl 2: spdx license identifier gpl
gpl 3: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl 3: this program is distributed in the hope that it will be useful but without any warranty
gpl 3: you should have received a copy of the gnu general public license
gpl 3: the gnu general public license is a free copyleft license
gpl 3: the licenses for most software and other practical works are designed to take away your freedom
gpl 3: the licenses for most software are designed to take away your freedom to share and change it
gpl 3: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-1.0 4: gnu general public license [version|v] 1|v1 [0]
gpl-1.0 4: [gnu] gpl [version|v] 1|v1 [0]
gpl-1.0 4: [gnu] gplv1
gpl-2.0 4: gnu general public license [version|v] 2|v2 [0]
gpl-2.0 4: [gnu] gpl [version|v] 2|v2 [0]
gpl-2.0 4: [gnu] gplv2|gpl2
gpl-2.0 4: gnu general public license as published by the free software foundation [either] version 2 [of the license]
gpl-2.0 5: spdx license identifier gpl 2 0 [only|or] [later]
gpl-3.0 4: gnu general public license [version|v] 3|v3 [0]
gpl-3.0 4: [gnu] gpl [version|v] 3|v3 [0]
gpl-3.0 4: [gnu] gplv3|gpl3
gpl-3.0 4: gnu general public license as published by the free software foundation [either] version 3 [of the license]
gpl-3.0 5: spdx license identifier gpl 3 0 [only|or] [later]
lgpl 1: [gnu] lesser|library general public license
lgpl 1: [gnu] lgpl
lgpl 1: lesser gpl
lgpl 2: licensed|released|distributed|available|covered under|by [the] [terms] [of] [the] [gnu] lgpl
lgpl 3: this library is free software you can redistribute it and or modify it under the terms of the gnu lesser|library general public license
lgpl 3: you should have received a copy of the gnu lesser|library general public license
lgpl 3: this version of the gnu lesser general public license incorporates the terms and conditions
lgpl-2.0 4: [gnu] lesser|library general public license [version|v] 2|v2 [0]
lgpl-2.0 4: [gnu] lgpl|lgplv2 [version|v] 2|v2 [0]
lgpl-2.0 4: lesser gpl [version|v] 2|v2 [0]
lgpl-2.1 4: [gnu] lesser|library general public license [version|v] 2|v2 1
lgpl-2.1 4: [gnu] lgpl [version|v] 2|v2 1
lgpl-2.1 4: lgplv2 1
lgpl-2.1 4: lesser gpl [version|v] 2|v2 1
lgpl-2.1 5: spdx license identifier lgpl 2 1 [only|or] [later]
lgpl-3.0 4: [gnu] lesser general public license [version|v] 3|v3 [0]
lgpl-3.0 4: [gnu] lgpl [version|v] 3|v3 [0]
lgpl-3.0 4: lgplv3|lgpl3
lgpl-3.0 4: lesser gpl [version|v] 3|v3 [0]
lgpl-3.0 5: spdx license identifier lgpl 3 0 [only|or] [later]
agpl 1: [gnu] affero general public license
agpl 1: [gnu] agpl
agpl 1: affero gpl
agpl 3: you should have received a copy of the gnu affero general public license
agpl 3: the gnu affero general public license is a free copyleft license for software and other kinds of works
agpl-3.0 4: [gnu] affero general public license [version|v] 3|v3 [0]
agpl-3.0 4: [gnu] agpl|agplv3 [version|v] 3|v3 [0]
agpl-3.0 4: agplv3|agpl3
agpl-3.0 5: spdx license identifier agpl 3 0 [only|or] [later]
gfdl 1: gnu free documentation license
gfdl 1: gfdl
gfdl 3: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl-1.1 4: gnu free documentation license [version|v] 1 1
gfdl-1.1 4: gfdl 1 1
gfdl-1.2 4: gnu free documentation license [version|v] 1 2
gfdl-1.2 4: gfdl 1 2
gfdl-1.3 4: gnu free documentation license [version|v] 1 3
gfdl-1.3 4: gfdl 1 3
gfdl-1.3 5: spdx license identifier gfdl 1 3
apache 1: apache [software] license|licence
apache 2: licensed|released|distributed|available under [the] [terms] [of] [the] apache [software] license|licence
apache 3: you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses
apache 3: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache 3: licensed to the apache software foundation asf under one or more contributor license agreements
apache 3: terms and conditions for use reproduction and distribution
apache-1.0 4: apache [software] [license|licence] [version|v] 1 0
apache-1.1 4: apache [software] [license|licence] [version|v] 1 1
apache-2.0 4: apache [software] license|licence [version|v] 2|v2 [0]
apache-2.0 4: apache 2|v2 0
apache-2.0 4: apache version 2 [0]
apache-2.0 4: apachev2|apache2 license|licence
apache-2.0 4: licensed|released|available under [the] apache 2|v2
apache-2.0 4: www apache org licenses license 2 0
apache-2.0 4: asl 2 0
apache-2.0 5: spdx license identifier apache 2 0
mit 1: mit license|licence
mit 1: expat|x11 license|licence
mit 1: mit style license|licence
mit 2: licensed|released|distributed|available|covered under|by [the] [terms] [of] [the] mit [license|licence]
mit 2: license|licence mit
mit 2: the mit license|licence mit
mit 3: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 3: permission is hereby granted free of charge to any person obtaining a copy
mit 3: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 3: the software is provided as is without warranty of any kind express or implied
mit 5: spdx license identifier mit
mit-0 4: mit no attribution
mit-0 5: spdx license identifier mit 0
bsd 1: [new|revised|modified|simplified|original|free] bsd [style|type] license|licence
bsd 2: licensed|released|distributed|available under [the] [terms] [of] [the] bsd [license|licence]
bsd 3: redistribution and use in source and binary forms with or without modification are permitted
bsd 3: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 3: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd 3: this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd-2-clause 4: bsd 2 clause [license|licence]
bsd-2-clause 4: 2|two clause bsd [license|licence]
bsd-2-clause 4: simplified bsd license|licence
bsd-2-clause 4: freebsd license|licence
bsd-2-clause 5: spdx license identifier bsd 2 clause
bsd-3-clause 4: bsd 3 clause [license|licence]
bsd-3-clause 4: 3|three clause bsd [license|licence]
bsd-3-clause 4: new|revised|modified bsd license|licence
bsd-3-clause 4: neither the name of [the] [copyright] [holder|holders] nor the names of its contributors may be used to endorse or promote products
bsd-3-clause 5: spdx license identifier bsd 3 clause
bsd-4-clause 4: bsd 4 clause [license|licence]
bsd-4-clause 4: 4|four clause bsd [license|licence]
bsd-4-clause 4: all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause 5: spdx license identifier bsd 4 clause
0bsd 4: zero clause bsd
0bsd 5: spdx license identifier 0bsd
isc 1: isc license|licence
isc 2: licensed|released|available under [the] isc [license|licence]
isc 3: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 5: spdx license identifier isc
mpl 1: mozilla public license|licence
mpl 2: licensed|released|available under [the] mpl
mpl 3: this source code form is subject to the terms of the mozilla public license
mpl 3: if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.0 4: mozilla public license|licence [version|v] 1 0
mpl-1.0 4: mpl 1 0
mpl-1.1 4: mozilla public license|licence [version|v] 1 1
mpl-1.1 4: mpl [version|v] 1 1
mpl-2.0 4: mozilla public license|licence [version|v] 2|v2 [0]
mpl-2.0 4: mpl [version|v] 2|v2 0
mpl-2.0 4: mplv2
mpl-2.0 4: mozilla org mpl 2 0
mpl-2.0 5: spdx license identifier mpl 2 0
epl 1: eclipse public license|licence
epl-1.0 4: eclipse public license|licence [version|v] 1|v1 [0]
epl-1.0 4: epl 1 0
epl-2.0 4: eclipse public license|licence [version|v] 2|v2 [0]
epl-2.0 4: epl 2 0
epl-2.0 5: spdx license identifier epl 2 0
epl 3: this program and the accompanying materials are made available under the terms of the eclipse public license
cddl 1: common development and distribution license|licence
cddl 1: cddl
cddl-1.0 4: common development and distribution license|licence [cddl] [version|v] 1 0
cddl-1.0 4: cddl 1 0
cddl-1.1 4: common development and distribution license|licence [cddl] [version|v] 1 1
cddl-1.1 4: cddl 1 1
cddl-1.0 5: spdx license identifier cddl 1 0
cpl 1: common public license|licence
cpl-1.0 4: common public license|licence [version|v] 1 0
eupl 1: european union public licence|license
eupl 1: eupl
eupl-1.1 4: european union public licence|license [version|v] 1 1
eupl-1.1 4: eupl [version|v] 1 1
eupl-1.2 4: european union public licence|license [version|v] 1 2
eupl-1.2 4: eupl [version|v] 1 2
eupl-1.2 5: spdx license identifier eupl 1 2
osl 1: open software license|licence
osl-3.0 4: open software license|licence [version|v] 3|v3 [0]
osl-3.0 5: spdx license identifier osl 3 0
afl 1: academic free license|licence
afl-3.0 4: academic free license|licence [version|v] 3|v3 [0]
afl-3.0 5: spdx license identifier afl 3 0
artistic 1: [perl|clarified] artistic license|licence
artistic-1.0 4: artistic license|licence [version|v] 1|v1 [0]
artistic-2.0 4: artistic license|licence [version|v] 2|v2 [0]
artistic-2.0 5: spdx license identifier artistic 2 0
artistic 3: the intent of this document is to state the conditions under which a package may be copied
bsl-1.0 4: boost software license|licence [version|v] [1] [0]
bsl-1.0 5: spdx license identifier bsl 1 0
bsl-1.0 3: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
busl 1: business source license|licence
busl-1.1 4: business source license|licence [version|v] 1 1
busl-1.1 5: spdx license identifier busl 1 1
sspl 1: server side public license|licence
sspl-1.0 4: server side public license|licence [version|v] 1|v1 [0]
sspl-1.0 5: spdx license identifier sspl 1 0
elastic 1: elastic license|licence
elastic-2.0 4: elastic license|licence [version|v] 2|v2 [0]
zlib 1: zlib [libpng] license|licence
zlib 2: licensed|released|available under [the] zlib [license|licence]
zlib 3: this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 3: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib 5: spdx license identifier zlib
libpng 1: libpng license|licence
unlicense 1: the unlicense
unlicense 2: licensed|released under [the] unlicense
unlicense 3: this is free and unencumbered software released into the public domain
unlicense 5: spdx license identifier unlicense
wtfpl 1: do what the fuck you want to public license|licence
wtfpl 1: wtfpl
wtfpl 3: you just do what the fuck you want to
wtfpl-2.0 4: do what the fuck you want to public license|licence version 2
wtfpl 5: spdx license identifier wtfpl
cc 1: creative commons license|licence
cc 3: this work is licensed under a creative commons
cc0 1: cc0
cc0 1: creative commons zero
cc0 1: creative commons public domain dedication
cc0 3: to the extent possible under law the author|authors|person|publisher has|have|who [waived|associated] [all] [cc0]
cc0 3: the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 4: cc0 [version|v] 1 0 [universal]
cc0-1.0 4: creativecommons org publicdomain zero 1 0
cc0-1.0 5: spdx license identifier cc0 1 0
cc-by 1: cc by
cc-by 1: creative commons attribution
cc-by 2: licensed|released|available under [a|the] cc by
cc-by-2.0 4: cc by 2 0
cc-by-2.5 4: cc by 2 5
cc-by-3.0 4: cc by 3 0
cc-by-3.0 4: creative commons attribution 3 0
cc-by-3.0 4: creativecommons org licenses by 3 0
cc-by-4.0 4: cc by 4 0
cc-by-4.0 4: creative commons attribution 4 0 [international]
cc-by-4.0 4: creativecommons org licenses by 4 0
cc-by-4.0 5: spdx license identifier cc by 4 0
cc-by-sa 1: cc by sa
cc-by-sa 1: creative commons attribution sharealike
cc-by-sa 1: creative commons attribution share alike
cc-by-sa-2.0 4: cc by sa 2 0
cc-by-sa-2.5 4: cc by sa 2 5
cc-by-sa-3.0 4: cc by sa 3 0
cc-by-sa-3.0 4: creative commons attribution sharealike 3 0
cc-by-sa-3.0 4: creative commons attribution share alike 3 0
cc-by-sa-3.0 4: creativecommons org licenses by sa 3 0
cc-by-sa-4.0 4: cc by sa 4 0
cc-by-sa-4.0 4: creative commons attribution sharealike 4 0 [international]
cc-by-sa-4.0 4: creativecommons org licenses by sa 4 0
cc-by-sa-4.0 5: spdx license identifier cc by sa 4 0
cc-by-nd 1: cc by nd
cc-by-nd 1: creative commons attribution noderivatives|noderivs
cc-by-nd 1: creative commons attribution no derivatives|derivs
cc-by-nd-3.0 4: cc by nd 3 0
cc-by-nd-4.0 4: cc by nd 4 0
cc-by-nd-4.0 4: creativecommons org licenses by nd 4 0
cc-by-nc 1: cc by nc
cc-by-nc 1: creative commons attribution noncommercial
cc-by-nc 1: creative commons attribution non commercial
cc-by-nc-2.0 4: cc by nc 2 0
cc-by-nc-3.0 4: cc by nc 3 0
cc-by-nc-4.0 4: cc by nc 4 0
cc-by-nc-4.0 4: creative commons attribution noncommercial 4 0 [international]
cc-by-nc-4.0 4: creativecommons org licenses by nc 4 0
cc-by-nc-sa 1: cc by nc sa
cc-by-nc-sa 1: creative commons attribution noncommercial sharealike
cc-by-nc-sa 1: creative commons attribution non commercial share alike
cc-by-nc-sa-2.0 4: cc by nc sa 2 0
cc-by-nc-sa-3.0 4: cc by nc sa 3 0
cc-by-nc-sa-4.0 4: cc by nc sa 4 0
cc-by-nc-sa-4.0 4: creativecommons org licenses by nc sa 4 0
cc-by-nc-nd 1: cc by nc nd
cc-by-nc-nd 1: creative commons attribution noncommercial noderivatives|noderivs
cc-by-nc-nd 1: creative commons attribution non commercial no derivatives|derivs
cc-by-nc-nd-3.0 4: cc by nc nd 3 0
cc-by-nc-nd-4.0 4: cc by nc nd 4 0
cc-by-nc-nd-4.0 4: creativecommons org licenses by nc nd 4 0
ofl 1: sil open font license|licence
ofl 1: open font license|licence
ofl-1.1 4: [sil] open font license|licence [version|v] 1 1
ofl-1.1 5: spdx license identifier ofl 1 1
odbl 1: open database license|licence
odbl 1: odbl
odbl-1.0 4: open database license|licence [version|v] 1 0
odbl-1.0 4: odbl 1 0
odc-by 1: open data commons attribution license|licence
pddl 1: open data commons public domain dedication
psf 1: python software foundation license|licence
psf 1: psf license|licence
psf-2.0 4: psf license|licence [version|v] 2|v2 [0]
psf-2.0 5: spdx license identifier psf 2 0
openssl 1: openssl license|licence
openssl 3: this product includes software developed by the openssl project
php 1: php license|licence
php-3.01 4: php license|licence [version|v] 3 01
ruby 1: ruby license|licence
w3c 1: w3c license|licence
w3c 1: w3c software [and] [document] notice and license|licence
ncsa 1: university of illinois [ncsa] open source license|licence
ncsa 1: ncsa license|licence
ncsa 5: spdx license identifier ncsa
postgresql 1: postgresql license|licence
postgresql 5: spdx license identifier postgresql
vim 1: vim license|licence
curl 1: curl license|licence
icu 1: icu license|licence
unicode 1: unicode license|licence agreement
unicode 1: unicode inc license|licence agreement
beerware 1: beer ware license|licence
beerware 3: as long as you retain this notice you can do whatever you want with this stuff
json 3: the software shall be used for good not evil
ms-pl 1: microsoft public license|licence
ms-rl 1: microsoft reciprocal license|licence
upl-1.0 4: universal permissive license|licence [version|v] [1] [0]
llama 1: llama [2|3] community license|licence [agreement]
openrail 1: openrail license|licence
openrail 1: creativeml open rail m [license|licence]
proprietary 1: proprietary license|licence
proprietary 1: end user license|licence agreement
proprietary 1: eula
proprietary 3: unauthorized copying of this file via any medium is strictly prohibited
proprietary 3: this software is confidential and proprietary information of
rights-reserved 1: all rights reserved
public-domain 1: public domain dedication
public-domain 1: dedicated to the public domain
public-domain 1: placed in|into the public domain
public-domain 1: released into|to the public domain
"""

#: A text without a word that begins with one of these matches no signature (checked in tests).
STEMS = ("licen", "gpl", "lgpl", "agpl", "gfdl", "cddl", "eupl", "wtfpl", "odbl", "cc0", "asl", "mpl", "epl", "apache", "bsd", "clause", "mozilla", "unlicense", "commons", "creativecommons", "creativeml", "domain", "redistribut", "warrant", "permi", "reserved", "unauthorized", "confidential", "eula", "fuck", "advertising", "conditions", "altered", "endorse", "extent", "deed", "developed", "evil", "retain", "attribution")


#: Signatures without such a word: cc by, and mit, isc or zlib after under or by.
NO_STEM = rf"cc{NOT_WORD}by(?![A-Za-z0-9\x{{80}}-\x{{10FFFF}}])|(?:under|by){NOT_WORD}(?:the{NOT_WORD})?(?:terms{NOT_WORD})?(?:of{NOT_WORD})?(?:the{NOT_WORD})?(?:mit|isc|zlib)(?![A-Za-z0-9\x{{80}}-\x{{10FFFF}}])"


def _spaced(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def compiled(signature: str) -> str:
    """Expression of a signature over the spaced form of a text, in which each word has a space of its own on either side."""
    word = lambda w: f" (?:{w}) " if "|" in w else f" {w} "
    parts = re.findall(r"\[[^\]]+\]|\S+", signature)
    return "".join(f"(?:{''.join(map(word, p[1:-1].split()))})?" if p[0] == "[" else word(p) for p in parts)


def keys_of(signature: str) -> list[str]:
    """The words that every match of a signature holds, the longest first, as they stand in the spaced form."""
    need = {w for w in re.sub(r"\[[^\]]+\]", " ", signature).split() if "|" not in w}
    return [f" {w} " for w in sorted(need, key=lambda w: (-len(w), w))]


def rules() -> list[tuple[list[str], str, str, int, float]]:
    """(keywords, regular expression, label, priority, weight) of every signature, by falling priority."""
    found = []
    for line in SIGNATURES.strip().splitlines():
        head, signature = line.split(": ")
        label, priority = head.rsplit(" ", 1)
        found.append((keys_of(signature), compiled(signature), label, int(priority), 0.2 if label == "rights-reserved" else WEIGHTS[int(priority)]))
    return sorted(found, key=lambda r: -r[3])


def spaced_words(text: Column) -> Column:
    """' w1  w2  w3 ' of the lower-cased words; only A-Z are lower-cased."""
    body = F.regexp_replace(F.translate(text, UPPER, LOWERED), NOT_WORD, "  ")
    return F.regexp_replace(F.concat(F.lit("  "), body, F.lit("  ")), r"^ +| +$", " ")


def _spans(gaps: Column, sizes: Column) -> Column:
    """{start, end} of places from what stands before each and from their sizes."""
    ends = running(F.zip_with(gaps, sizes, lambda g, s: g + s), lambda x, y: x + y)
    return F.zip_with(ends, sizes, lambda e, s: F.struct((e - s).alias("start"), e.alias("end")))


def _hits(text: Column, pattern: Column, size) -> Column:
    """{start, end} of each place of a pattern, in what size() counts."""

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        return let(F.transform(hits, size), lambda sizes: _spans(F.transform(gaps, size), sizes))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def _n_words(x: Column) -> Column:
    return F.size(F.split(x, "[^ ]+", -1)) - 1


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Detections of every text, one row per row of df.

    Columns: doc_id, n_words, n_base (all places of base phrases), first_word and last_word
    (smallest and largest word at which one starts, or null), base_labels, labels, score (1
    minus the product of what the kept rules leave open) and detections (array of {label,
    priority, weight, start, end}: words, end exclusive). Null text is empty; an empty text
    has no words and no labels. Repeated rows give repeated results, an empty table none;
    other columns of df, whatever their names, are not read. Texts of any length are read
    whole, and work grows nearly in proportion to a text's length and places. Work on a text
    without any keyword is one count and one gate.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    gate = rf"(?i)(?<![A-Za-z0-9\x{{80}}-\x{{10FFFF}}])(?:{'|'.join(STEMS)}|{NO_STEM})"
    out = df.select(F.col(id_col).alias("doc_id"), text.alias("__t"))
    out = out.withColumn("n_words", F.regexp_count("__t", F.lit(WORD)).cast("long"))
    out = out.withColumn("__w", F.when(F.col("__t").rlike(gate), spaced_words(F.col("__t")))).drop("__t")
    w = F.col("__w")

    def base_places(phrase: str, label: str) -> Column:
        labelled = F.transform(_hits(w, F.lit(_spaced(phrase)), F.char_length), lambda x: F.struct(F.lit(label).alias("label"), x["start"].alias("start")))
        return F.coalesce(F.when(w.contains(_spaced(phrase)), labelled), F.array().cast("array<struct<label:string,start:int>>"))

    out = out.withColumn("__base", F.when(w.isNotNull(), F.concat(*[base_places(*x) for x in BASE])))

    rule = "array<struct<keys:array<string>,pattern:string,label:string,priority:int,weight:double>>"
    names = ("keys", "pattern", "label", "priority", "weight")
    literal = F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rules()])), rule)  # one constant: the planner has no 303 structs to go through
    out = out.withColumn("__rules", F.when(w.isNotNull(), F.filter(literal, lambda r: F.forall(r["keys"], w.contains) & F.rlike(w, r["pattern"]))))

    def places(r: Column) -> Column:
        return F.transform(_hits(w, r["pattern"], _n_words), lambda x: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight"), x["start"].alias("start"), x["end"].alias("end")))

    found = F.flatten(F.transform(F.col("__rules"), places))
    # in order of start, then longest, then highest priority: as plain fields, so that sorting needs no comparing function
    keyed = F.transform(found, lambda x: F.struct(x["start"].alias("s"), (-x["end"]).alias("e"), (-x["priority"]).alias("p"), x["label"].alias("l"), x["weight"].alias("w")))
    out = out.withColumn("__all", F.when(F.size("__rules") > 0, F.sort_array(keyed)))
    # then a detection is inside an earlier one of at least its priority exactly when one of these ends no sooner
    every, none = F.col("__all"), F.array().cast("array<struct<label:string,priority:int,weight:double,start:int,end:int>>")
    def reach(p: int) -> Column:
        return running(F.transform(every, lambda x: F.when(-x["p"] >= p, -x["e"]).otherwise(F.lit(-1))), lambda x, y: F.greatest(x, y))

    def outer(reaches: Column) -> Column:
        def kept(x: Column, i: Column) -> Column:
            return (i == 0) | (F.get(F.get(reaches, -x["p"] - 1), i - 1) < -x["e"])

        return F.transform(F.filter(every, kept), lambda x: F.struct(x["l"].alias("label"), (-x["p"]).alias("priority"), x["w"].alias("weight"), x["s"].alias("start"), (-x["e"]).alias("end")))

    # bound once, outside of the filter: a column would be put in its place and computed for every detection
    picked = let(F.array(*[reach(p) for p in range(1, 6)]), outer)
    out = out.withColumn("detections", F.coalesce(picked, none)).drop("__rules", "__all")

    base = F.col("__base")
    first = F.array_min(F.transform(base, lambda x: x["start"]))
    last = F.array_max(F.transform(base, lambda x: x["start"]))
    before = lambda at: (F.size(F.split(F.substring(F.col("__w"), F.lit(1), at), "[^ ]+", -1)) - 1).cast("long")
    base_labels = F.array_distinct(F.transform(F.coalesce(base, F.array().cast("array<struct<label:string,start:int>>")), lambda x: x["label"]))
    weights = F.aggregate(F.col("detections"), F.lit(1.0), lambda a, x: a * (F.lit(1.0) - x["weight"]))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"),
        F.when(F.size(base) > 0, before(first)).alias("first_word"),
        F.when(F.size(base) > 0, before(last)).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.transform(F.col("detections"), lambda x: x["label"]))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.greatest(F.lit(1.0) - weights, F.lit(0.5))).otherwise(F.lit(1.0) - weights).alias("score"),
        "detections",
    )
