"""Signature rules of the license scan, written by hand, in order: priority, then place in the list.

A rule is (label, keywords, priority, score, regex). The regex reads the words of a text, lower-cased and joined by single
blanks, and matches whole words. Every match holds one of the keywords as a word. Priorities: 5 machine-readable tags,
4 grants and bodies of licenses, 3 names with the word license, 2 short names with a version, 1 hints.
"""

from __future__ import annotations


def v(number: str) -> str:
    """A version: bare, after "version" or "v", or glued to a v; 2 also as 2 0 and 2.1 as 2 1."""
    parts = number.split(".")
    tail = f" {parts[1]}" if len(parts) > 1 else "(?: 0)?"
    return f"(?:version |ver |v ?)?{parts[0]}{tail}"


#: Words between a grant's verb and the license's name.
UNDER = "(?:licensed|released|distributed|published|provided|offered|available|covered|redistributed) (?:under|by)(?: the terms of| the terms and conditions of)?(?: the| an| a)?"
OF = "(?:license|licence|licensed|terms of|rights under|governed by|subject to)(?: the| an| a| is| type| name){0,3}"
TAG = "spdx license identifier"
CC = "creative commons"
ND = "no ?deriv(?:ative)?s?(?: works)?"
NC = "non ?commercial"
SA = "share ?alike"

RULES: list[tuple[str, str, int, float, str]] = [
    # -- machine-readable tags
    ("mit", "mit", 5, 0.99, f"{TAG} mit(?! 0)"),
    ("mit-0", "mit", 5, 0.99, f"{TAG} mit 0"),
    ("x11", "x11", 5, 0.99, f"{TAG} x11"),
    ("isc", "isc", 5, 0.99, f"{TAG} isc"),
    ("0bsd", "0bsd", 5, 0.99, f"{TAG} 0bsd"),
    ("bsd-2", "bsd", 5, 0.99, f"{TAG} bsd 2 clause"),
    ("bsd-3", "bsd", 5, 0.99, f"{TAG} bsd 3 clause"),
    ("bsd-4", "bsd", 5, 0.99, f"{TAG} bsd 4 clause"),
    ("apache-1", "apache", 5, 0.99, f"{TAG} apache 1 [01]"),
    ("apache-2", "apache", 5, 0.99, f"{TAG} apache 2 0"),
    ("gpl-2", "gpl", 5, 0.99, f"{TAG} gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gpl", 5, 0.99, f"{TAG} gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "lgpl", 5, 0.99, f"{TAG} lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", 5, 0.99, f"{TAG} lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lgpl", 5, 0.99, f"{TAG} lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "agpl", 5, 0.99, f"{TAG} agpl 3 0(?: only| or later)?"),
    ("mpl-1.1", "mpl", 5, 0.99, f"{TAG} mpl 1 1"),
    ("mpl-2", "mpl", 5, 0.99, f"{TAG} mpl 2 0"),
    ("epl-1", "epl", 5, 0.99, f"{TAG} epl 1 0"),
    ("epl-2", "epl", 5, 0.99, f"{TAG} epl 2 0"),
    ("eupl-1.2", "eupl", 5, 0.99, f"{TAG} eupl 1 2"),
    ("artistic-2", "artistic", 5, 0.99, f"{TAG} artistic 2 0"),
    ("boost-1", "bsl", 5, 0.99, f"{TAG} bsl 1 0"),
    ("busl-1.1", "busl", 5, 0.99, f"{TAG} busl 1 1"),
    ("zlib", "zlib", 5, 0.99, f"{TAG} zlib"),
    ("unlicense", "unlicense", 5, 0.99, f"{TAG} unlicense"),
    ("wtfpl", "wtfpl", 5, 0.99, f"{TAG} wtfpl"),
    ("postgresql", "postgresql", 5, 0.99, f"{TAG} postgresql"),
    ("python-2", "python", 5, 0.99, f"{TAG} python 2 0"),
    ("openssl", "openssl", 5, 0.99, f"{TAG} openssl"),
    ("ofl-1.1", "ofl", 5, 0.99, f"{TAG} ofl 1 1"),
    ("cc0", "cc0", 5, 0.99, f"{TAG} cc0 1 0"),
    ("cc-by", "cc", 5, 0.99, f"{TAG} cc by [1-4] 0"),
    ("cc-by-sa", "cc", 5, 0.99, f"{TAG} cc by sa [1-4] 0"),
    ("cc-by-nc", "cc", 5, 0.99, f"{TAG} cc by nc [1-4] 0"),
    ("cc-by-nd", "cc", 5, 0.99, f"{TAG} cc by nd [1-4] 0"),
    ("cc-by-nc-sa", "cc", 5, 0.99, f"{TAG} cc by nc sa [1-4] 0"),
    ("cc-by-nc-nd", "cc", 5, 0.99, f"{TAG} cc by nc nd [1-4] 0"),
    ("odbl-1", "odbl", 5, 0.99, f"{TAG} odbl 1 0"),
    ("sspl-1", "sspl", 5, 0.99, f"{TAG} sspl 1 0"),
    ("elastic-2", "elastic", 5, 0.99, f"{TAG} elastic 2 0"),
    ("apache-2", "apache2", 5, 0.9, "license apache2"),
    ("mit", "osi", 5, 0.99, "osi approved(?: license)? mit(?: license)?"),
    ("bsd-3", "osi", 5, 0.85, "osi approved(?: license)? bsd(?: license)?"),
    ("apache-2", "osi", 5, 0.95, "osi approved(?: license)? apache(?: software)?(?: license)?(?: 2 0)?"),
    ("gpl-3", "osi", 5, 0.95, "osi approved(?: license)? gnu general public license v3"),
    # -- grants
    ("mit", "mit", 4, 0.95, f"{UNDER} mit(?! 0| no)(?: x11)?(?: style)?(?: license| licence)?"),
    ("mit-0", "mit", 4, 0.95, f"{UNDER} mit (?:no attribution|0)(?: license| licence)?"),
    ("x11", "x11", 4, 0.95, f"{UNDER} x11(?: license| licence)?"),
    ("isc", "isc", 4, 0.95, f"{UNDER} isc(?: license| licence)?"),
    ("0bsd", "0bsd bsd", 4, 0.95, f"{UNDER} (?:0bsd|zero clause bsd|bsd 0 clause|bsd zero clause)(?: license| licence)?"),
    ("bsd-2", "bsd", 4, 0.95, f"{UNDER} (?:simplified bsd|freebsd bsd|bsd (?:2|two) clause|(?:2|two) clause bsd)(?: license| licence)?"),
    ("bsd-3", "bsd", 4, 0.95, f"{UNDER} (?:new bsd|revised bsd|modified bsd|bsd (?:3|three) clause|(?:3|three) clause bsd)(?: license| licence)?"),
    ("bsd-4", "bsd", 4, 0.95, f"{UNDER} (?:original bsd|old bsd|bsd (?:4|four) clause|(?:4|four) clause bsd)(?: license| licence)?"),
    ("bsd", "bsd", 4, 0.85, f"{UNDER} bsd(?: style)? (?:license|licence)"),
    ("apache-1", "apache", 4, 0.95, f"{UNDER} apache(?: software)?(?: license| licence)? (?:version |v ?)?1 [01]"),
    ("apache-2", "apache", 4, 0.95, f"{UNDER} apache(?: software)?(?: license| licence)? {v('2')}"),
    ("apache-2", "apache", 4, 0.95, f"apache(?: software)? (?:license|licence) {v('2')}"),
    ("gpl-1", "general", 4, 0.95, f"{UNDER} gnu general public (?:license|licence) {v('1')}"),
    ("gpl-2", "general", 4, 0.95, f"{UNDER} gnu general public (?:license|licence) {v('2')}(?: only| or later| or any later version)?"),
    ("gpl-3", "general", 4, 0.95, f"{UNDER} gnu general public (?:license|licence) {v('3')}(?: only| or later| or any later version)?"),
    ("gpl-2", "gpl gplv2 gpl2", 4, 0.95, f"{UNDER} (?:gnu )?(?:gpl {v('2')}|gplv2|gpl2)(?: only| or later)?(?: license| licence)?"),
    ("gpl-3", "gpl gplv3 gpl3", 4, 0.95, f"{UNDER} (?:gnu )?(?:gpl {v('3')}|gplv3|gpl3)(?: only| or later)?(?: license| licence)?"),
    ("gpl", "gpl", 4, 0.8, f"{UNDER} (?:gnu )?gpl(?! (?:version|ver|v|[1-3]))(?: license| licence)?"),
    ("gpl-2", "general", 4, 0.95, "gnu general public license as published by the free software foundation(?: either)? version 2(?: of the license)?"),
    ("gpl-3", "general", 4, 0.95, "gnu general public license as published by the free software foundation(?: either)? version 3(?: of the license)?"),
    ("lgpl-2", "general", 4, 0.95, f"{UNDER} gnu (?:library|lesser) general public (?:license|licence) {v('2')}(?! 1)"),
    ("lgpl-2.1", "lesser", 4, 0.95, f"{UNDER} gnu lesser general public (?:license|licence) {v('2.1')}"),
    ("lgpl-3", "lesser", 4, 0.95, f"{UNDER} gnu lesser general public (?:license|licence) {v('3')}"),
    ("lgpl-2.1", "lgpl lgplv2", 4, 0.95, f"{UNDER} (?:gnu )?(?:lgpl {v('2.1')}|lgplv2 1)"),
    ("lgpl-3", "lgpl lgplv3", 4, 0.95, f"{UNDER} (?:gnu )?(?:lgpl {v('3')}|lgplv3)"),
    ("agpl-3", "affero", 4, 0.95, f"{UNDER} (?:gnu )?affero general public (?:license|licence) {v('3')}"),
    ("agpl-3", "agpl agplv3", 4, 0.95, f"{UNDER} (?:gnu )?(?:agpl {v('3')}|agplv3)"),
    ("mpl-1.1", "mozilla mpl", 4, 0.95, f"{UNDER} (?:mozilla public license|mpl) {v('1.1')}"),
    ("mpl-2", "mozilla mpl", 4, 0.95, f"{UNDER} (?:mozilla public license|mpl) {v('2')}"),
    ("mpl-2", "mozilla", 4, 0.95, "this source code form is subject to the terms of the mozilla public license v ?2 0"),
    ("epl-1", "eclipse epl", 4, 0.95, f"{UNDER} (?:eclipse public license|epl) {v('1')}"),
    ("epl-2", "eclipse epl", 4, 0.95, f"{UNDER} (?:eclipse public license|epl) {v('2')}"),
    ("cddl-1", "cddl", 4, 0.95, f"{UNDER} cddl(?: (?:version |v ?)?1(?: [01])?)?"),
    ("eupl-1.2", "eupl", 4, 0.95, f"{UNDER} eupl {v('1.2')}"),
    ("artistic-1", "artistic", 4, 0.95, f"{UNDER} artistic license {v('1')}"),
    ("artistic-2", "artistic", 4, 0.95, f"{UNDER} artistic license {v('2')}"),
    ("artistic-1", "perl", 4, 0.85, "under the same terms as perl itself"),
    ("boost-1", "boost", 4, 0.95, f"{UNDER} boost software license(?: (?:version |v ?)?1(?: 0)?)?"),
    ("zlib", "zlib", 4, 0.95, f"{UNDER} zlib(?: libpng)?(?: license| licence)?"),
    ("unlicense", "unlicense", 4, 0.95, f"{UNDER} unlicense"),
    ("wtfpl", "wtfpl", 4, 0.95, f"{UNDER} wtfpl"),
    ("postgresql", "postgresql", 4, 0.95, f"{UNDER} postgresql(?: license| licence)?"),
    ("python-2", "python psf", 4, 0.95, f"{UNDER} (?:python software foundation|psf) (?:license|licence)"),
    ("openssl", "openssl", 4, 0.95, f"{UNDER} openssl(?: license| licence)?"),
    ("ofl-1.1", "ofl font", 4, 0.95, f"{UNDER} (?:sil )?(?:ofl|open font license) {v('1.1')}"),
    ("cc0", "cc0", 4, 0.95, f"{UNDER} cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc", 4, 0.95, f"{UNDER} cc by(?! (?:nc|nd|sa))(?: [1-4] [0-9])?"),
    ("cc-by-sa", "cc", 4, 0.95, f"{UNDER} cc by sa(?: [1-4] [0-9])?"),
    ("cc-by-nd", "cc", 4, 0.95, f"{UNDER} cc by nd(?: [1-4] [0-9])?"),
    ("cc-by-nc", "cc", 4, 0.95, f"{UNDER} cc by nc(?! (?:nd|sa))(?: [1-4] [0-9])?"),
    ("cc-by-nc-sa", "cc", 4, 0.95, f"{UNDER} cc by nc sa(?: [1-4] [0-9])?"),
    ("cc-by-nc-nd", "cc", 4, 0.95, f"{UNDER} cc by nc nd(?: [1-4] [0-9])?"),
    ("cc-by", "attribution", 4, 0.95, f"{UNDER} {CC} attribution(?! (?:non|no |noderiv|share))(?: [1-4] 0)?(?: international)?"),
    ("odbl-1", "odbl database", 4, 0.95, f"{UNDER} (?:odbl|open database license)"),
    ("sspl-1", "sspl", 4, 0.95, f"{UNDER} (?:sspl|server side public license sspl)"),
    ("busl-1.1", "business", 4, 0.95, f"{UNDER} business source license(?: 1 1)?"),
    ("elastic-2", "elastic", 4, 0.95, f"{UNDER} elastic license(?: {v('2')})?"),
    ("ms-pl", "microsoft", 4, 0.95, f"{UNDER} microsoft public license(?: ms pl)?"),
    ("public-domain", "domain", 4, 0.9, "(?:released|dedicated|placed|put|donated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", 4, 0.9, "(?:is|are) in the public domain"),
    # -- bodies
    ("mit", "hereby", 4, 0.95, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "portions", 4, 0.9, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission", 4, 0.9, "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", 4, 0.9, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "endorse", 4, 0.9, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", "advertising", 4, 0.9, "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("apache-2", "compliance", 4, 0.85, "you may not use this file except in compliance with the license"),
    ("apache-2", "warranties", 4, 0.8, "distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "redistribute", 4, 0.85, "this program is free software you can redistribute it and or modify it"),
    ("gpl", "warranty", 4, 0.7, "in the hope that it will be useful but without any warranty"),
    ("lgpl", "redistribute", 4, 0.85, "this library is free software you can redistribute it and or modify it"),
    ("zlib", "plainly", 4, 0.9, "altered source versions must be plainly marked as such"),
    ("zlib", "warranty", 4, 0.85, "provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "unencumbered", 4, 0.95, "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", 4, 0.9, "do what the fuck you want to(?: public license)?"),
    ("boost-1", "organization", 4, 0.9, "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("cc0", "neighboring", 4, 0.85, "to the extent possible under law(?: [a-z]+){1,9} waived? all copyright and related or neighboring rights"),
    ("artistic-2", "perl", 4, 0.8, "this package is free software you may redistribute it and or modify it under the same terms as perl"),
    ("ofl-1.1", "reserved", 4, 0.85, "with reserved font name"),
    ("openssl", "toolkit", 4, 0.9, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("commons-clause", "commons", 4, 0.9, "commons clause license condition"),
    # -- names with the word license
    ("mit", "mit", 3, 0.85, "(?:the )?mit (?:license|licence|licensed)"),
    ("mit", "expat", 3, 0.85, "expat (?:license|licence)"),
    ("mit", "mit", 3, 0.8, f"{OF} mit(?! 0| no)"),
    ("mit-0", "mit", 3, 0.85, "mit (?:0|no attribution) (?:license|licence)"),
    ("x11", "x11", 3, 0.85, "x11 (?:license|licence)"),
    ("isc", "isc", 3, 0.85, "isc (?:license|licence|licensed)"),
    ("isc", "isc", 3, 0.8, f"{OF} isc"),
    ("0bsd", "0bsd", 3, 0.85, "0bsd(?: license| licence| licensed)?"),
    ("0bsd", "bsd", 3, 0.85, "(?:zero clause bsd|bsd zero clause)(?: license| licence| licensed)?"),
    ("bsd-2", "bsd", 3, 0.85, "(?:simplified bsd|bsd 2 clause|(?:2|two) clause bsd)(?: license| licence)?"),
    ("bsd-3", "bsd", 3, 0.85, "(?:new bsd|revised bsd|modified bsd|bsd 3 clause|(?:3|three) clause bsd)(?: license| licence)?"),
    ("bsd-4", "bsd", 3, 0.85, "(?:original bsd|bsd 4 clause|(?:4|four) clause bsd)(?: license| licence)?"),
    ("bsd", "bsd", 3, 0.75, "bsd (?:license|licence|licensed)"),
    ("bsd", "bsd", 3, 0.75, f"{OF} bsd"),
    ("apache-1", "apache", 3, 0.85, "apache(?: software)? (?:license|licence) (?:version |v ?)?1 [01]"),
    ("apache-2", "apache", 3, 0.85, f"{OF} apache {v('2')}"),
    ("apache-2", "apache", 3, 0.85, f"apache {v('2')} (?:license|licence|licensed)"),
    ("apache", "apache", 3, 0.7, "apache(?: software)? (?:license|licence)(?! (?:version|ver|v|[12]))"),
    ("gpl-1", "general", 3, 0.85, f"gnu general public (?:license|licence) {v('1')}"),
    ("gpl-2", "general", 3, 0.85, f"gnu general public (?:license|licence) {v('2')}"),
    ("gpl-3", "general", 3, 0.85, f"gnu general public (?:license|licence) {v('3')}"),
    ("gpl", "general", 3, 0.75, "gnu general public (?:license|licence)(?! (?:version [1-3]|ver [1-3]|v ?[1-3]|v[1-3]|[1-3]))"),
    ("lgpl-2", "library", 3, 0.85, f"gnu library general public (?:license|licence) {v('2')}"),
    ("lgpl-2.1", "lesser", 3, 0.85, f"(?:gnu )?lesser general public (?:license|licence) {v('2.1')}"),
    ("lgpl-3", "lesser", 3, 0.85, f"(?:gnu )?lesser general public (?:license|licence) {v('3')}"),
    ("lgpl", "lesser", 3, 0.75, "(?:gnu )?lesser general public (?:license|licence)(?! (?:version [23]|ver [23]|v ?[23]|v[23]|[23]))"),
    ("agpl-3", "affero", 3, 0.85, f"affero general public (?:license|licence) {v('3')}"),
    ("agpl", "affero", 3, 0.75, "affero general public (?:license|licence)(?! (?:version 3|ver 3|v ?3|v3|3))"),
    ("mpl-1.1", "mozilla", 3, 0.85, f"mozilla public (?:license|licence) {v('1.1')}"),
    ("mpl-2", "mozilla", 3, 0.85, f"mozilla public (?:license|licence) {v('2')}"),
    ("epl-1", "eclipse", 3, 0.85, f"eclipse public (?:license|licence) {v('1')}"),
    ("epl-2", "eclipse", 3, 0.85, f"eclipse public (?:license|licence) {v('2')}"),
    ("cpl-1", "common", 3, 0.85, f"common public (?:license|licence)(?: {v('1')})?"),
    ("cddl-1", "distribution", 3, 0.85, f"common development and distribution (?:license|licence)(?: {v('1')})?"),
    ("cecill-2.1", "cecill", 3, 0.85, f"cecill(?: free software)?(?: license| licence)?(?: agreement)?(?: {v('2.1')})?"),
    ("eupl-1.2", "union", 3, 0.85, f"european union public (?:license|licence) {v('1.2')}"),
    ("artistic-2", "artistic", 3, 0.85, f"artistic (?:license|licence) {v('2')}"),
    ("boost-1", "boost", 3, 0.85, "boost software (?:license|licence)"),
    ("zlib", "zlib", 3, 0.85, "zlib(?: libpng)? (?:license|licence|licensed)"),
    ("zlib", "zlib", 3, 0.75, f"{OF} zlib"),
    ("wtfpl", "wtfpl", 3, 0.8, "wtfpl(?: license| licence| licensed)?"),
    ("unlicense", "unlicense", 3, 0.8, "(?:the )?unlicense"),
    ("postgresql", "postgresql", 3, 0.85, "postgresql (?:license|licence|licensed)"),
    ("python-2", "python", 3, 0.85, "python software foundation (?:license|licence)(?: agreement)?(?: (?:version |v ?)?2)?"),
    ("openssl", "openssl", 3, 0.85, "openssl (?:license|licence|licensed)"),
    ("php-3", "php", 3, 0.85, "php (?:license|licence) (?:version |v ?)?3(?: 0[01]?)?"),
    ("ruby", "ruby", 3, 0.75, "ruby (?:license|licence)"),
    ("ofl-1.1", "font", 3, 0.85, f"(?:sil )?open font (?:license|licence)(?: {v('1.1')})?"),
    ("ms-pl", "microsoft", 3, 0.85, "microsoft public (?:license|licence)"),
    ("ms-rl", "microsoft", 3, 0.85, "microsoft reciprocal (?:license|licence)"),
    ("sspl-1", "server", 3, 0.85, "server side public (?:license|licence)"),
    ("busl-1.1", "business", 3, 0.85, "business source (?:license|licence)(?: (?:version |v ?)?1 1)?"),
    ("odbl-1", "database", 3, 0.85, f"open database (?:license|licence)(?: {v('1')})?"),
    ("odc-by-1", "commons", 3, 0.85, "open data commons attribution (?:license|licence)"),
    ("pddl-1", "dedication", 3, 0.85, "open data commons public domain dedication(?: and license)?"),
    ("cc0", "dedication cc0 creative", 3, 0.85, f"cc0 1 0 universal(?: public domain dedication)?|{CC} (?:zero|public domain dedication)|public domain dedication"),
    ("cc-by", "attribution", 3, 0.85, f"{CC} attribution(?! (?:non|no |noderiv|share))(?: [1-4] [05])?(?: international)?(?: license| licence)?"),
    ("cc-by-sa", "attribution", 3, 0.85, f"{CC} attribution {SA}(?: [1-4] [05])?(?: international| unported)?(?: license| licence)?"),
    ("cc-by-nd", "attribution", 3, 0.85, f"{CC} attribution {ND}(?: [1-4] [05])?(?: international| unported)?(?: license| licence)?"),
    ("cc-by-nc", "attribution", 3, 0.85, f"{CC} attribution {NC}(?! (?:no|share))(?: [1-4] [05])?(?: international| unported)?(?: license| licence)?"),
    ("cc-by-nc-sa", "attribution", 3, 0.85, f"{CC} attribution {NC} {SA}(?: [1-4] [05])?(?: international| unported)?(?: license| licence)?"),
    ("cc-by-nc-nd", "attribution", 3, 0.85, f"{CC} attribution {NC} {ND}(?: [1-4] [05])?(?: international| unported)?(?: license| licence)?"),
    ("gfdl", "documentation", 3, 0.85, "gnu free documentation (?:license|licence)"),
    ("ogl-3", "government", 3, 0.85, f"open government (?:license|licence)(?: {v('3')})?"),
    ("llama", "llama", 3, 0.85, "llama(?: [23](?: [0-9])?)? community (?:license|licence)(?: agreement)?"),
    ("openrail", "openrail rail", 3, 0.85, "(?:creativeml )?open ?rail(?: m| plus plus| plus plus m)?(?: license| licence)?|openrail(?: m)?"),
    # -- short names with a version
    ("apache-2", "apache", 2, 0.75, f"apache {v('2')}"),
    ("gpl-2", "gpl gplv2 gpl2", 2, 0.75, f"(?:gnu )?(?:gpl {v('2')}|gplv2|gpl2)"),
    ("gpl-3", "gpl gplv3 gpl3", 2, 0.75, f"(?:gnu )?(?:gpl {v('3')}|gplv3|gpl3)"),
    ("lgpl-2.1", "lgpl lgplv2", 2, 0.75, f"(?:gnu )?(?:lgpl {v('2.1')}|lgplv2 1)"),
    ("lgpl-3", "lgpl lgplv3", 2, 0.75, f"(?:gnu )?(?:lgpl {v('3')}|lgplv3)"),
    ("agpl-3", "agpl agplv3", 2, 0.75, f"(?:gnu )?(?:agpl {v('3')}|agplv3)"),
    ("mpl-1.1", "mpl", 2, 0.75, f"mpl {v('1.1')}"),
    ("mpl-2", "mpl mplv2", 2, 0.75, f"mpl {v('2')}|mplv2(?: 0)?"),
    ("epl-1", "epl", 2, 0.7, "epl (?:version |v ?)?1(?: 0)"),
    ("epl-2", "epl", 2, 0.7, "epl (?:version |v ?)?2(?: 0)"),
    ("cddl-1", "cddl", 2, 0.75, "cddl(?: (?:version |v ?)?1(?: [01])?)?"),
    ("eupl-1.2", "eupl", 2, 0.75, f"eupl {v('1.2')}"),
    ("ofl-1.1", "ofl", 2, 0.75, f"(?:sil )?ofl {v('1.1')}"),
    ("cc0", "cc0", 2, 0.75, "cc0(?: 1 0)?"),
    ("cc-by", "cc", 2, 0.75, "cc by(?! (?:nc|nd|sa)) [1-4] [05]"),
    ("cc-by-sa", "cc", 2, 0.75, "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", 2, 0.75, "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", 2, 0.75, "cc by nc(?! (?:nd|sa))(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", 2, 0.75, "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", 2, 0.75, "cc by nc nd(?: [1-4] [05])?"),
    ("odbl-1", "odbl", 2, 0.75, "odbl(?: (?:version |v ?)?1(?: 0)?)?"),
    ("pddl-1", "pddl", 2, 0.75, "pddl(?: (?:version |v ?)?1(?: 0)?)?"),
    ("sspl-1", "sspl", 2, 0.75, "sspl(?: (?:version |v ?)?1(?: 0)?)?"),
    ("gfdl", "gfdl", 2, 0.75, "(?:gnu )?gfdl(?: 1 [1-3])?"),
    # -- hints
    ("all-rights-reserved", "reserved", 1, 0.5, "all rights(?: are)? reserved"),
    ("some-rights-reserved", "reserved", 1, 0.4, "some rights(?: are)? reserved"),
    ("proprietary", "proprietary", 1, 0.6, "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", 1, 0.6, "unauthorized (?:copying|use|reproduction)(?: or distribution)? of this (?:file|software|document|work)"),
    ("proprietary", "prohibited", 1, 0.5, "(?:copying|reproduction|redistribution) is strictly prohibited"),
    ("noncommercial", "commercial", 1, 0.4, "(?:for )?non commercial use only|not for commercial use"),
    ("permission-required", "permission", 1, 0.4, "(?:reproduced|used|reprinted) (?:only )?with(?: the)?(?: written| express)? permission"),
    ("public-domain", "domain", 1, 0.4, "public domain (?:work|mark|content|notice)"),
]
