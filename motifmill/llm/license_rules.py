"""Signature rules of licenses, over normalised words (lower case, punctuation gone, one blank between words).

A rule: label, priority (lower goes first), confidence, the anchor and one of the keys (divided by |) that a text must hold for the rule to be
tried, and the pattern.
Names, addresses and phrases are written by hand; WAYS are the ways in which a text refers to a name.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    anchor: str
    keys: str
    pattern: str


# Phrases and labels that always count.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_CONFIDENCE = 0.9

#: label, keys (words or parts of them), words of the SPDX identifier, pattern of the name without the word "license" behind it.
NAMES = (
    ("mit", "mit", "mit", r"mit(?: x11)?"),
    ("mit", "expat", "mit expat", r"expat(?: mit)?"),
    ("mit-0", "attribution", "mit 0", r"mit no attribution"),
    ("x11", "x11", "x11", r"x11(?: mit)?|x consortium"),
    ("apache-1", "apache", "apache 1 [01]", r"apache(?: software)?(?: licen[sc]e)?(?: version| v)? 1 [01]"),
    ("apache-2", "apache", "apache 2 0", r"apache(?: software)?(?: licen[sc]e)?(?: version| v)? 2(?: 0)?|apache v2(?: 0)?|asl 2 0"),
    ("apache", "apache", "apache", r"apache(?: software)?"),
    ("bsd-0", "0bsd", "0bsd", r"0bsd|zero clause bsd|free public"),
    ("bsd-2", "bsd", "bsd 2 clause", r"(?:simplified|freebsd|2 clause|two clause)(?: bsd)?|bsd 2(?: clause)?"),
    ("bsd-3", "bsd", "bsd 3 clause", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd 3(?: clause)?"),
    ("bsd-4", "bsd", "bsd 4 clause", r"(?:original|4 clause|four clause) bsd|bsd 4(?: clause)?"),
    ("bsd", "bsd", "bsd", r"bsd(?: style)?"),
    ("gpl-1", "gpl|general", "gpl 1 0(?: only)?", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? v?1(?: 0)?|(?:gnu )?gplv1"),
    ("gpl-2", "gpl|general", "gpl 2 0(?: only)?", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? v?2(?: 0)?|(?:gnu )?gplv2"),
    ("gpl-3", "gpl|general", "gpl 3 0(?: only)?", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? v?3(?: 0)?|(?:gnu )?gplv3"),
    ("gpl-2-or-later", "later", "gpl 2 0 or later", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? v?2(?: 0)?(?: or| of the licen[sc]e or)(?: at your option)?(?: any)? later(?: version)?"),
    ("gpl-3-or-later", "later", "gpl 3 0 or later", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? v?3(?: 0)?(?: or| of the licen[sc]e or)(?: at your option)?(?: any)? later(?: version)?"),
    ("gpl", "gpl|general", "gpl", r"gnu gpl|gpl|gnu general public"),
    ("lgpl-2", "lgpl|general", "lgpl 2 0(?: only)?", r"(?:gnu )?(?:lgpl|(?:library|lesser) general public licen[sc]e)(?: version| v)? v?2(?: 0)?|(?:gnu )?lgplv2"),
    ("lgpl-2.1", "lgpl|general", "lgpl 2 1(?: only)?", r"(?:gnu )?(?:lgpl|(?:library|lesser) general public licen[sc]e)(?: version| v)? v?2 1|(?:gnu )?lgplv2 1"),
    ("lgpl-3", "lgpl|general", "lgpl 3 0(?: only)?", r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version| v)? v?3(?: 0)?|(?:gnu )?lgplv3"),
    ("lgpl-2.1-or-later", "later", "lgpl 2 1 or later", r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version| v)? v?2 1(?: or| of the licen[sc]e or)(?: at your option)?(?: any)? later(?: version)?"),
    ("lgpl-3-or-later", "later", "lgpl 3 0 or later", r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version| v)? v?3(?: 0)?(?: or| of the licen[sc]e or)(?: at your option)?(?: any)? later(?: version)?"),
    ("lgpl", "lgpl|general", "lgpl", r"gnu lgpl|lgpl|gnu (?:lesser|library) general public"),
    ("agpl-3", "agpl|affero", "agpl 3 0(?: only)?", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: version| v)? v?3(?: 0)?|(?:gnu )?agplv3"),
    ("agpl-3-or-later", "later", "agpl 3 0 or later", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: version| v)? v?3(?: 0)?(?: or| of the licen[sc]e or)(?: at your option)?(?: any)? later(?: version)?"),
    ("agpl", "agpl|affero", "agpl", r"gnu agpl|agpl|gnu affero general public"),
    ("gfdl", "fdl|documentation", "gfdl 1 [123](?: only| or later)?", r"(?:gnu )?(?:gfdl|fdl|free documentation)"),
    ("mpl-1", "mozilla", "mpl 1 [01]", r"mozilla public(?: licen[sc]e)?(?: version| v)? 1 [01]"),
    ("mpl-2", "mozilla", "mpl 2 0", r"mozilla public(?: licen[sc]e)?(?: version| v)? v?2(?: 0)?"),
    ("mpl-2", "mpl", "mpl 2 0", r"mpl(?: version| v)? v?2(?: 0)?"),
    ("mpl", "mozilla", "mpl", r"mozilla public"),
    ("epl-1", "eclipse", "epl 1 0", r"eclipse public(?: licen[sc]e)?(?: version| v)? v?1(?: 0)?"),
    ("epl-2", "eclipse", "epl 2 0", r"eclipse public(?: licen[sc]e)?(?: version| v)? v?2(?: 0)?"),
    ("epl", "eclipse", "epl", r"eclipse public"),
    ("edl", "eclipse", "edl 1 0", r"eclipse distribution"),
    ("cddl", "common", "cddl 1 [01]", r"common development and distribution|cddl"),
    ("cpl", "common", "cpl 1 0", r"common public"),
    ("cpal", "common", "cpal 1 0", r"common public attribution"),
    ("isc", "isc", "isc", r"isc|internet systems consortium"),
    ("zlib", "zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", "libpng(?: 2 0)?", r"libpng|png reference library"),
    ("bsl-1", "boost", "bsl 1 0", r"boost(?: software)?"),
    ("busl-1.1", "business", "busl 1 1", r"business source"),
    ("unlicense", "unlicense", "unlicense", r"the unlicense|unlicense"),
    ("wtfpl", "wtfpl|want", "wtfpl", r"wtfpl|do what the f[a-z]* you want to(?: public)?"),
    ("artistic-1", "artistic", "artistic 1 0(?: perl)?", r"artistic(?: licen[sc]e)?(?: version| v)? 1(?: 0)?"),
    ("artistic-2", "artistic", "artistic 2 0", r"artistic(?: licen[sc]e)?(?: version| v)? 2(?: 0)?"),
    ("artistic", "artistic", "artistic", r"(?:clarified |perl )?artistic"),
    ("python-2", "python", "python 2 0", r"python software foundation|psf|python"),
    ("php-3", "php", "php 3 01?", r"php"),
    ("ruby", "ruby", "ruby", r"ruby"),
    ("openssl", "openssl", "openssl", r"openssl(?: ssleay)?"),
    ("curl", "curl", "curl", r"curl"),
    ("postgresql", "postgresql", "postgresql", r"postgresql"),
    ("ntp", "ntp", "ntp", r"ntp"),
    ("ofl-1.1", "ofl|font", "ofl 1 1", r"(?:sil )?open font|sil ofl|ofl"),
    ("w3c", "w3c", "w3c", r"w3c(?: software)?(?: notice and)?"),
    ("ms-pl", "microsoft|ms", "ms pl", r"microsoft public|ms pl"),
    ("ms-rl", "microsoft|ms", "ms rl", r"microsoft reciprocal|ms rl"),
    ("eupl-1.2", "eupl|european", "eupl 1 2", r"european union public(?: licen[sc]e)?(?: version| v)? 1 2|eupl(?: v)? ?1 2"),
    ("eupl", "eupl|european", "eupl 1 [01]", r"european union public|eupl"),
    ("ecl-2", "educational", "ecl 2 0", r"educational community"),
    ("osl-3", "open", "osl 3 0", r"open software"),
    ("afl-3", "academic", "afl 3 0", r"academic free"),
    ("ncsa", "ncsa", "ncsa", r"ncsa|university of illinois ncsa(?: open source)?"),
    ("vim", "vim", "vim", r"vim"),
    ("tcl", "tcl", "tcl", r"tcl tk|tcl"),
    ("odbl-1", "odbl|database", "odbl 1 0", r"open database|odbl"),
    ("odc-by-1", "odc|data", "odc by 1 0", r"open data commons attribution|odc by"),
    ("pddl-1", "pddl|dedication", "pddl 1 0", r"(?:open data commons )?public domain dedication and|pddl"),
    ("mulan-2", "mulan", "mulanpsl 2 0", r"mulan(?: permissive software)?"),
    ("sspl-1", "sspl|server", "sspl 1 0", r"server side public|sspl"),
    ("elastic-2", "elastic", "elastic 2 0", r"elastic"),
    ("openrail", "rail", "openrail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?|responsible ai"),
    ("llama", "llama", "llama ?\\d?", r"llama(?: \d)?(?: community)?"),
    ("cc0-1", "cc0", "cc0 1 0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero"),
    ("cc-by", "cc|commons", "cc by [1-4] [05]", r"cc by(?: [1-4] [05])?|creative commons attribution(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-sa", "cc|commons", "cc by sa [1-4] [05]", r"cc by sa(?: [1-4] [05])?|creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nd", "cc|commons", "cc by nd [1-4] [05]", r"cc by nd(?: [1-4] [05])?|creative commons attribution no ?derivs?(?:atives)?(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", "cc|commons", "cc by nc [1-4] [05]", r"cc by nc(?: [1-4] [05])?|creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-sa", "cc|commons", "cc by nc sa [1-4] [05]", r"cc by nc sa(?: [1-4] [05])?|creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-nd", "cc|commons", "cc by nc nd [1-4] [05]", r"cc by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?derivs?(?:atives)?(?: [1-4] [05])?(?: international| unported)?"),
)
#: priority, confidence, anchor, pattern around the name ({spdx} or {name}).
WAYS = (
    (0, 1.0, "spdx", r"spdx licen[sc]e identifier {spdx}"),
    (1, 0.95, "under", r"(?:dual )?(?:licen[sc]ed|released|distributed|available|published|provided|covered|shared|redistributed)(?: to you)? under(?: the)?(?: terms(?: and conditions)? of(?: the)?)? {name}(?: licen[sc]e)?"),
    (2, 0.85, "licen", r"licen[sc]es?(?: type| name| terms| information)?(?: is)?(?: the)? {name}"),
    (3, 0.75, "licen", r"{name} licen[sc]es?"),
)
#: label, key, words of an address.
ADDRESSES = (
    ("mit", "mit", r"opensource org licen[sc]es? mit(?: license php)?"),
    ("bsd-2", "bsd", r"opensource org licen[sc]es? bsd 2 clause"),
    ("bsd-3", "bsd", r"opensource org licen[sc]es? bsd 3 clause"),
    ("isc", "isc", r"opensource org licen[sc]es? isc(?: license txt)?"),
    ("apache-2", "apache", r"(?:www )?apache org licen[sc]es? licen[sc]e 2 0(?: txt| html)?"),
    ("apache-2", "apache", r"opensource org licen[sc]es? apache 2 0"),
    ("gpl-2", "gpl", r"(?:www )?gnu org licen[sc]es?(?: old licenses)? gpl 2 0(?: txt| html)?"),
    ("gpl-3", "gpl", r"(?:www )?gnu org licen[sc]es? gpl(?: 3 0)?(?: txt| html)?"),
    ("lgpl-2.1", "lgpl", r"(?:www )?gnu org licen[sc]es?(?: old licenses)? lgpl 2 1(?: txt| html)?"),
    ("lgpl-3", "lgpl", r"(?:www )?gnu org licen[sc]es? lgpl(?: 3 0)?(?: txt| html)?"),
    ("agpl-3", "agpl", r"(?:www )?gnu org licen[sc]es? agpl(?: 3 0)?(?: txt| html)?"),
    ("gfdl", "fdl", r"(?:www )?gnu org licen[sc]es? fdl(?: 1 [123])?(?: txt| html)?"),
    ("mpl-2", "mozilla", r"(?:www )?mozilla org(?: en us)? mpl 2 0"),
    ("epl-1", "eclipse", r"(?:www )?eclipse org legal epl v10(?: html)?"),
    ("epl-2", "eclipse", r"(?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?"),
    ("bsl-1", "boost", r"(?:www )?boost org license 1 0 txt"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"(?:www |sam zoy org )wtfpl(?: net)?"),
    ("ofl-1.1", "ofl", r"scripts sil org ofl"),
    ("cc0-1", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons", r"creativecommons org licen[sc]es? by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licen[sc]es? by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licen[sc]es? by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licen[sc]es? by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licen[sc]es? by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licen[sc]es? by nc nd [1-4] [05]"),
    ("odbl-1", "opendatacommons", r"opendatacommons org licen[sc]es? odbl"),
    ("odc-by-1", "opendatacommons", r"opendatacommons org licen[sc]es? by"),
    ("pddl-1", "opendatacommons", r"opendatacommons org licen[sc]es? pddl"),
)
#: label, anchor, key, confidence, a phrase of the license's own text or notice.
PHRASES = (
    ("mit", "permission", "hereby", 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "copies", "substantial", 0.8, r"shall be included in all copies or substantial portions of the software"),
    ("isc", "permission", "fee", 0.9, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "binary", 0.85, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "endorse", "promote", 0.9, r"neither the name of(?: the)?(?: \S+){1,6} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4", "advertising", "acknowledgement", 0.9, r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2", "licen", "compliance", 0.95, r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-1", "software", "apache", 0.85, r"this product includes software developed by the apache software foundation"),
    ("gpl", "software", "redistribute", 0.85, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "software", "redistribute", 0.85, r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("gpl", "warranty", "merchantability", 0.6, r"without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e"),
    ("agpl", "network", "affero", 0.8, r"remote network interaction use with the gnu general public licen[sc]e"),
    ("gfdl", "permission", "invariant", 0.9, r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", "source", "mozilla", 0.95, r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl-1", "software", "mozilla", 0.9, r"the contents of this file are subject to the mozilla public licen[sc]e version 1 [01]"),
    ("zlib", "warranty", "origin", 0.9, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1", "permission", "hereby", 0.9, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
    ("unlicense", "software", "unencumbered", 0.95, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", "public", 0.8, r"(?:released|placed|dedicated)(?: in)?(?: to| into| in) the public domain"),
    ("public-domain", "domain", "public", 0.6, r"this (?:work|text|file|document|software) is in the public domain"),
    ("cc0-1", "domain", "waived", 0.8, r"has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "commons", "attribution", 0.6, r"this work is licensed under a creative commons attribution(?: [1-4] [05])?(?: international| unported)? licen[sc]e"),
    ("wtfpl", "want", "you", 0.9, r"you just do what the f[a-z]* you want to"),
    ("ofl-1.1", "font", "licen", 0.9, r"this font software is licensed under the sil open font licen[sc]e version 1 1"),
    ("artistic", "perl", "terms", 0.7, r"(?:redistribute|distributed)(?: it and or modify it)? under the same terms as perl(?: itself)?"),
    ("ruby", "ruby", "terms", 0.6, r"under the same terms as ruby(?: itself)?"),
    ("vim", "vim", "charityware", 0.8, r"vim is charityware"),
    ("beerware", "beer", "return", 0.9, r"you can buy me a beer in return"),
    ("beerware", "licen", "beer", 0.8, r"(?:the )?beer ?ware licen[sc]e"),
    ("json", "software", "evil", 0.9, r"the software shall be used for good not evil"),
    ("proprietary", "reserved", "rights", 0.5, r"all rights reserved"),
    ("proprietary", "confidential", "proprietary", 0.7, r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "permission", "reproduced", 0.6, r"(?:may not be|no part of this (?:publication|work|book|document) may be) reproduced(?: \S+){0,12} without(?: the)?(?: prior)?(?: express)?(?: written)? permission"),
    ("proprietary", "licen", "commercial", 0.5, r"commercial licen[sc]e (?:is )?required"),
    ("non-commercial", "commercial", "use", 0.5, r"(?:for|free for) non ?commercial use only"),
    ("research-only", "research", "only", 0.5, r"(?:for|limited to) (?:academic|research)(?: and research| purposes| use)? only"),
    ("crown", "crown", "copyright", 0.6, r"(?:c )?crown copyright"),
    ("ogl-3", "government", "open", 0.8, r"open government licen[sc]e(?: v| version)? ?v?3(?: 0)?"),
    ("ogl", "government", "open", 0.7, r"open government licen[sc]e"),
)


def rules() -> tuple[Rule, ...]:
    """All signature rules: BASE first, then the others by priority."""
    out = [Rule(label, -1, BASE_CONFIDENCE, "", phrase.split()[0], phrase) for phrase, label in BASE]
    for label, key, spdx, name in NAMES:
        out += [Rule(label, priority, sure, anchor, "" if anchor == "spdx" else key, way.format(spdx=spdx, name=f"(?:{name})")) for priority, sure, anchor, way in WAYS]
    out += [Rule(label, 1, 0.95, "org" if "org" in words else "wtfpl", key, words) for label, key, words in ADDRESSES]
    out += [Rule(label, 1, sure, anchor, key, phrase) for label, anchor, key, sure, phrase in PHRASES]
    return tuple(sorted(out, key=lambda r: r.priority))
