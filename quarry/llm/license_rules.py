"""Signature rules of licenses, written one by one.

Each rule: label, keyword (every match holds it; a text without it isn't searched), regex.  Texts are lower-cased and their white
space is made single before, so that one space stands for any.  Rules are listed by kind; a kind has a priority (1 is
highest) and a confidence.
"""

from __future__ import annotations

#: Sentences of license bodies, and the standard headers that files carry.
BODIES = (
    ("mit", "free of charge, to any person", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "included in all copies or substantial", r"the above copyright notice and this permission notice (?:\([^)]{0,60}\) )?shall be included in all copies or substantial portions of the software"),
    ("mit-0", "without restriction, including", r"to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\.? the software is provided"),
    ("mit-cmu", "permission to use, copy", r"permission to use, copy, modify,? and distribute this software and its (?:associated )?documentation for any purpose (?:and without fee|is hereby granted without fee)"),
    ("x11", "x consortium", r"except as contained in this notice, the name of the x consortium shall not be used in advertising"),
    ("isc", "with or without fee", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that"),
    ("0bsd", "with or without fee", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\. the software"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("bsd", "redistributions of source code must", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of .{1,120}? nor the names of (?:its|their) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse or promote", r"the names? of (?:the )?(?:author|contributor|copyright holder)s? may not be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause-patent", "copyright holder and contributor", r"redistribution and use .{1,400}? subject to the terms and conditions of this license, each copyright holder and contributor hereby grants"),
    ("apache-2.0", "apache license, version 2", r"licensed under the apache license, version 2(?:\.0)?(?: \(the [\"']?license[\"']?\))?"),
    ("apache-2.0", "apache.org/licenses", r"(?:www\.)?apache\.org/licenses/license-2\.0"),
    ("apache-2.0", "terms and conditions for use", r"apache license version 2\.0, january 2004 (?:https?://www\.apache\.org/licenses/ )?terms and conditions for use, reproduction, and distribution"),
    ("apache-2.0", "grant of copyright license", r"grant of copyright license\. subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl", "it under the terms of the gnu general", r"you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0-or-later", "either version 2", r"gnu general public license as published by the free software foundation[;,] either version 2 of the license, or \(at your option\) any later version"),
    ("gpl-3.0-or-later", "either version 3", r"gnu general public license as published by the free software foundation[;,] either version 3 of the license, or \(at your option\) any later version"),
    ("gpl-2.0-only", "version 2", r"gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl-2.0", "version 2, june 1991", r"gnu general public license version 2, june 1991"),
    ("gpl-3.0", "version 3, 29 june 2007", r"gnu general public license version 3, 29 june 2007"),
    ("gpl", "copyleft license for", r"the gnu general public license is a free, copyleft license for software"),
    ("gpl", "copy of the gnu general", r"you should have received a copy of the gnu general public license"),
    ("gpl", "gnu.org/licenses/", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl-2.1-or-later", "either version 2.1", r"gnu lesser general public license as published by the free software foundation[;,] either version 2\.1 of the license, or \(at your option\) any later version"),
    ("lgpl-3.0-or-later", "either version 3", r"gnu lesser general public license as published by the free software foundation[;,] either version 3 of the license, or \(at your option\) any later version"),
    ("lgpl-2.0-or-later", "library general", r"gnu library general public license as published by the free software foundation[;,] either version 2 of the license, or \(at your option\) any later version"),
    ("lgpl-2.1", "version 2.1, february 1999", r"gnu lesser general public license version 2\.1, february 1999"),
    ("lgpl", "copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl", "gnu.org/licenses/", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl-3.0-or-later", "affero", r"gnu affero general public license as published by the free software foundation[;,] either version 3 of the license, or \(at your option\) any later version"),
    ("agpl-3.0", "19 november 2007", r"gnu affero general public license version 3, 19 november 2007"),
    ("agpl-3.0", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", "gnu.org/licenses/agpl", r"gnu\.org/licenses/agpl"),
    ("gfdl", "document under the terms", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "gnu.org/licenses/fdl", r"gnu\.org/licenses/fdl"),
    ("mpl-2.0", "mozilla public license, v. 2", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-2.0", "mozilla.org/mpl/2", r"mozilla\.org/mpl/2\.0"),
    ("mpl-1.1", "mozilla public license version 1.1", r"contents of this file are subject to the mozilla public license version 1\.1"),
    ("npl-1.1", "netscape public license", r"contents of this file are subject to the netscape public license version 1\.1"),
    ("epl-2.0", "eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2\.0"),
    ("epl-1.0", "eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1\.0"),
    ("cpl-1.0", "common public license", r"made available under the terms of the common public license v(?:ersion)? ?1\.0"),
    ("cddl-1.0", "common development and distribution", r"contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl-1.2", "eupl", r"licensed under the eupl,? (?:version|v\.?) ?1\.2"),
    ("eupl-1.1", "eupl", r"licensed under the eupl,? (?:version|v\.?) ?1\.1"),
    ("zlib", "in no event will the authors", r"this software is provided 'as-is', without any express or implied warranty\. in no event will the authors be held liable"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("boost-1.0", "boost software license", r"distributed under the boost software license,? version 1\.0"),
    ("boost-1.0", "person or organization obtaining", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want", r"do what the fuck you want to public license"),
    ("artistic-2.0", "artistic license", r"the artistic license 2\.0 copyright \(c\) 2000"),
    ("artistic-1.0", "artistic license", r"the [\"']artistic license[\"'] preamble"),
    ("python-2.0", "psf license agreement", r"psf license agreement for python"),
    ("postgresql", "postgresql", r"postgresql (?:database management system|is released under the postgresql license)"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project"),
    ("openssl", "eric young", r"this product includes cryptographic software written by eric young"),
    ("php-3.01", "php license", r"this source file is subject to version 3\.01 of the php license"),
    ("vim", "vim", r"distribute (?:unmodified|modified) copies of vim"),
    ("curl", "daniel stenberg", r"copyright \(c\) 1996 - 20[0-9]{2}, daniel stenberg"),
    ("unicode", "unicode data files", r"permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files"),
    ("ofl-1.1", "this font software is licensed", r"this font software is licensed under the sil open font license, version 1\.1"),
    ("ofl-1.1", "scripts.sil.org/ofl", r"scripts\.sil\.org/ofl"),
    ("bsl-1.1", "business source license", r"use of this software is governed by the business source license"),
    ("sspl-1.0", "server side public license", r"under the terms of the server side public license, version 1"),
    ("elastic-2.0", "elastic license", r"licensed under the elastic license 2\.0"),
    ("ms-pl", "you accept this license", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("cc0-1.0", "publicdomain/zero", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related (?:and|or) neighbou?ring rights"),
    ("cc-pdm", "publicdomain/mark", r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("cc-by", "creativecommons.org/licenses/by/", r"creativecommons\.org/licenses/by/[1-4]\.[05]"),
    ("cc-by-sa", "creativecommons.org/licenses/by-sa", r"creativecommons\.org/licenses/by-sa/[1-4]\.[05]"),
    ("cc-by-nd", "creativecommons.org/licenses/by-nd", r"creativecommons\.org/licenses/by-nd/[1-4]\.[05]"),
    ("cc-by-nc", "creativecommons.org/licenses/by-nc/", r"creativecommons\.org/licenses/by-nc/[1-4]\.[05]"),
    ("cc-by-nc-sa", "creativecommons.org/licenses/by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]"),
    ("cc-by-nc-nd", "creativecommons.org/licenses/by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]"),
    ("public-domain", "public domain", r"(?:dedicate|release)[sd]? (?:any and all copyright interest|this work|this file|it) (?:in the software )?(?:in)?to the public domain"),
    ("proprietary", "strictly prohibited", r"unauthori[sz]ed copying of this file,? via any medium,? is strictly prohibited"),
    ("proprietary", "all rights reserved", r"proprietary and confidential\. all rights reserved"),
)

#: Names that are clear by themselves: identifiers after a tag, and full names with a version.
NAMES = (
    ("mit", "spdx", r"spdx-license-identifier: ?\(?mit(?![a-z0-9-])"),
    ("mit-0", "spdx", r"spdx-license-identifier: ?\(?mit-0(?![a-z0-9])"),
    ("isc", "spdx", r"spdx-license-identifier: ?\(?isc(?![a-z0-9])"),
    ("0bsd", "spdx", r"spdx-license-identifier: ?\(?0bsd(?![a-z0-9])"),
    ("bsd-2-clause", "spdx", r"spdx-license-identifier: ?\(?bsd-2-clause(?![a-z0-9-])"),
    ("bsd-3-clause", "spdx", r"spdx-license-identifier: ?\(?bsd-3-clause(?![a-z0-9-])"),
    ("apache-2.0", "spdx", r"spdx-license-identifier: ?\(?apache-2\.0(?![a-z0-9])"),
    ("gpl-2.0-only", "spdx", r"spdx-license-identifier: ?\(?gpl-2\.0(?:-only)?(?![a-z0-9+-])"),
    ("gpl-2.0-or-later", "spdx", r"spdx-license-identifier: ?\(?gpl-2\.0(?:\+|-or-later)"),
    ("gpl-3.0-only", "spdx", r"spdx-license-identifier: ?\(?gpl-3\.0(?:-only)?(?![a-z0-9+-])"),
    ("gpl-3.0-or-later", "spdx", r"spdx-license-identifier: ?\(?gpl-3\.0(?:\+|-or-later)"),
    ("lgpl-2.1-only", "spdx", r"spdx-license-identifier: ?\(?lgpl-2\.1(?:-only)?(?![a-z0-9+-])"),
    ("lgpl-2.1-or-later", "spdx", r"spdx-license-identifier: ?\(?lgpl-2\.1(?:\+|-or-later)"),
    ("lgpl-3.0-or-later", "spdx", r"spdx-license-identifier: ?\(?lgpl-3\.0(?:\+|-or-later)"),
    ("agpl-3.0", "spdx", r"spdx-license-identifier: ?\(?agpl-3\.0(?:-only)?(?![a-z0-9+-])"),
    ("agpl-3.0-or-later", "spdx", r"spdx-license-identifier: ?\(?agpl-3\.0(?:\+|-or-later)"),
    ("mpl-2.0", "spdx", r"spdx-license-identifier: ?\(?mpl-2\.0(?![a-z0-9])"),
    ("epl-2.0", "spdx", r"spdx-license-identifier: ?\(?epl-2\.0(?![a-z0-9])"),
    ("cddl-1.0", "spdx", r"spdx-license-identifier: ?\(?cddl-1\.0(?![a-z0-9])"),
    ("boost-1.0", "spdx", r"spdx-license-identifier: ?\(?bsl-1\.0(?![a-z0-9])"),
    ("zlib", "spdx", r"spdx-license-identifier: ?\(?zlib(?![a-z0-9])"),
    ("unlicense", "spdx", r"spdx-license-identifier: ?\(?unlicense(?![a-z0-9])"),
    ("cc0-1.0", "spdx", r"spdx-license-identifier: ?\(?cc0-1\.0(?![a-z0-9])"),
    ("cc-by-4.0", "spdx", r"spdx-license-identifier: ?\(?cc-by-4\.0(?![a-z0-9])"),
    ("cc-by-sa-4.0", "spdx", r"spdx-license-identifier: ?\(?cc-by-sa-4\.0(?![a-z0-9])"),
    ("apache-2.0", "apache", r"\bapache(?: software)? licen[cs]e,? \(?v(?:ersion|\.)? ?2(?:\.0)?\b"),
    ("apache-2.0", "apache", r"\bapache[ -]2\.0(?: licen[cs]e)?\b"),
    ("apache-1.1", "apache", r"\bapache(?: software)? licen[cs]e,? \(?v(?:ersion|\.)? ?1\.1\b"),
    ("apache-1.0", "apache", r"\bapache(?: software)? licen[cs]e,? \(?v(?:ersion|\.)? ?1\.0\b"),
    ("gpl-2.0", "general public", r"\bgnu general public licen[cs]e,? \(?(?:version |v\.? ?)2(?:\.0)?\b"),
    ("gpl-3.0", "general public", r"\bgnu general public licen[cs]e,? \(?(?:version |v\.? ?)3(?:\.0)?\b"),
    ("gpl-2.0", "gpl", r"\b(?:gnu )?gpl[ -]?(?:version |v)?2(?:\.0)?(?:-only|\+)?(?![a-z0-9])"),
    ("gpl-3.0", "gpl", r"\b(?:gnu )?gpl[ -]?(?:version |v)?3(?:\.0)?(?:-only|\+)?(?![a-z0-9])"),
    ("lgpl-2.1", "lgpl", r"\b(?:gnu )?lgpl[ -]?(?:version |v)?2\.1(?:-only|\+)?(?![a-z0-9])"),
    ("lgpl-3.0", "lgpl", r"\b(?:gnu )?lgpl[ -]?(?:version |v)?3(?:\.0)?(?:-only|\+)?(?![a-z0-9])"),
    ("lgpl-2.1", "lesser general", r"\b(?:gnu )?lesser general public licen[cs]e,? \(?(?:version |v\.? ?)2\.1\b"),
    ("lgpl-3.0", "lesser general", r"\b(?:gnu )?lesser general public licen[cs]e,? \(?(?:version |v\.? ?)3(?:\.0)?\b"),
    ("agpl-3.0", "agpl", r"\b(?:gnu )?agpl[ -]?(?:version |v)?3(?:\.0)?(?:-only|\+)?(?![a-z0-9])"),
    ("agpl-3.0", "affero", r"\b(?:gnu )?affero general public licen[cs]e,? \(?(?:version |v\.? ?)3(?:\.0)?\b"),
    ("gfdl-1.3", "free documentation", r"\b(?:gnu )?free documentation licen[cs]e,? \(?(?:version |v\.? ?)1\.3\b"),
    ("gfdl-1.2", "free documentation", r"\b(?:gnu )?free documentation licen[cs]e,? \(?(?:version |v\.? ?)1\.2\b"),
    ("mpl-2.0", "mpl", r"\bmpl[ -]?(?:version |v)?2(?:\.0)?(?![a-z0-9])"),
    ("mpl-1.1", "mpl", r"\bmpl[ -]?(?:version |v)?1\.1(?![a-z0-9])"),
    ("mpl-2.0", "mozilla public", r"\bmozilla public licen[cs]e,? \(?(?:version |v\.? ?)?2(?:\.0)?\b"),
    ("mpl-1.1", "mozilla public", r"\bmozilla public licen[cs]e,? \(?(?:version |v\.? ?)?1\.1\b"),
    ("epl-2.0", "epl", r"\bepl[ -]?(?:version |v)?2\.0(?![a-z0-9])"),
    ("epl-1.0", "epl", r"\bepl[ -]?(?:version |v)?1\.0(?![a-z0-9])"),
    ("eupl-1.2", "eupl", r"\beupl[ -]?(?:version |v)?1\.2(?![a-z0-9])"),
    ("bsd-2-clause", "clause", r"\b(?:bsd[ -](?:2|two)|(?:2|two))[ -]clause(?: bsd)?(?: licen[cs]e)?\b"),
    ("bsd-3-clause", "clause", r"\b(?:bsd[ -](?:3|three)|(?:3|three))[ -]clause(?: bsd)?(?: licen[cs]e)?\b"),
    ("bsd-4-clause", "clause", r"\b(?:bsd[ -](?:4|four)|(?:4|four))[ -]clause(?: bsd)?(?: licen[cs]e)?\b"),
    ("bsd-3-clause", "bsd", r"\b(?:new|revised|modified) bsd licen[cs]e\b"),
    ("bsd-2-clause", "bsd", r"\b(?:simplified bsd|freebsd) licen[cs]e\b"),
    ("cc-by-nc-nd", "cc", r"\bcc[ -]by[ -]nc[ -]nd(?:[ -][1-4]\.[05])?(?![a-z0-9-])"),
    ("cc-by-nc-sa", "cc", r"\bcc[ -]by[ -]nc[ -]sa(?:[ -][1-4]\.[05])?(?![a-z0-9-])"),
    ("cc-by-nc", "cc", r"\bcc[ -]by[ -]nc(?:[ -][1-4]\.[05])?(?![a-z0-9-])"),
    ("cc-by-nd", "cc", r"\bcc[ -]by[ -]nd(?:[ -][1-4]\.[05])?(?![a-z0-9-])"),
    ("cc-by-sa", "cc", r"\bcc[ -]by[ -]sa(?:[ -][1-4]\.[05])?(?![a-z0-9-])"),
    ("cc-by", "cc", r"\bcc[ -]by[ -][1-4]\.[05](?![a-z0-9-])"),
    ("cc0-1.0", "cc0", r"\bcc0(?:[ -]1\.0)?(?: universal)?\b"),
    ("cc-by-nc-nd", "creative commons attribution", r"\bcreative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "creative commons attribution", r"\bcreative commons attribution[ -]non-?commercial[ -]share-?alike"),
    ("cc-by-nc", "creative commons attribution", r"\bcreative commons attribution[ -]non-?commercial"),
    ("cc-by-sa", "creative commons attribution", r"\bcreative commons attribution[ -]share-?alike"),
    ("cc-by-nd", "creative commons attribution", r"\bcreative commons attribution[ -]no-?deriv(?:ative)?s"),
    ("cc-by", "creative commons attribution", r"\bcreative commons attribution(?: [1-4]\.[05])?"),
    ("odbl-1.0", "odbl", r"\bodbl(?:[ -](?:v)?1\.0)?\b"),
    ("odc-by-1.0", "odc-by", r"\bodc-by(?:[ -](?:v)?1\.0)?\b"),
    ("pddl-1.0", "pddl", r"\bpddl(?:[ -](?:v)?1\.0)?\b"),
)

#: Notices: a license named as the one that applies.
NOTICES = (
    ("mit", "mit", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit(?: licen[cs]e)?(?![a-z0-9])"),
    ("apache", "apache", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache(?: licen[cs]e)?(?![a-z0-9])"),
    ("gpl", "gpl", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?![a-z0-9])"),
    ("gpl", "general public", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e"),
    ("lgpl", "lgpl", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl(?![a-z0-9])"),
    ("agpl-3.0", "agpl", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl(?![a-z0-9])"),
    ("bsd", "bsd", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the )?bsd(?:[ -]style)?(?: licen[cs]e)?(?![a-z0-9])"),
    ("isc", "isc", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?isc(?: licen[cs]e)?(?![a-z0-9])"),
    ("mpl", "mpl", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mpl(?![a-z0-9])"),
    ("epl", "epl", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?epl(?![a-z0-9])"),
    ("cc-by", "cc", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the |a )?cc[ -]by(?![a-z0-9-])"),
    ("cc", "creative commons", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the |a )?creative commons licen[cs]e"),
    ("unlicense", "unlicense", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?unlicense(?![a-z0-9])"),
    ("wtfpl", "wtfpl", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?wtfpl(?![a-z0-9])"),
    ("zlib", "zlib", r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?zlib(?:/libpng)?(?: licen[cs]e)?(?![a-z0-9])"),
    ("public-domain", "public domain", r"\b(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("mit", "mit", r"\blicen[cs]e ?[:=] ?[\"']?(?:the )?mit(?![a-z0-9-])"),
    ("apache", "apache", r"\blicen[cs]e ?[:=] ?[\"']?(?:the )?apache(?![a-z0-9-])"),
    ("gpl", "gpl", r"\blicen[cs]e ?[:=] ?[\"']?(?:the )?(?:gnu )?gpl(?![a-z0-9])"),
    ("bsd", "bsd", r"\blicen[cs]e ?[:=] ?[\"']?(?:the )?bsd(?![a-z0-9])"),
    ("isc", "isc", r"\blicen[cs]e ?[:=] ?[\"']?(?:the )?isc(?![a-z0-9])"),
    ("zlib", "zlib", r"\blicen[cs]e ?[:=] ?[\"']?(?:the )?zlib(?![a-z0-9])"),
    ("unlicense", "unlicense", r"\blicen[cs]e ?[:=] ?[\"']?(?:the )?unlicense(?![a-z0-9])"),
    ("cc-by", "cc", r"\blicen[cs]e ?[:=] ?[\"']?(?:the )?cc[ -]by(?![a-z0-9-])"),
    ("public-domain", "public domain", r"\blicen[cs]e ?[:=] ?[\"']?public domain"),
    ("proprietary", "proprietary", r"\blicen[cs]e ?[:=] ?[\"']?proprietary"),
)

#: Names of licenses without more.
MENTIONS = (
    ("mit", "mit", r"\bmit licen[cs]es?\b"),
    ("mit", "expat", r"\bexpat licen[cs]es?\b"),
    ("x11", "x11", r"\bx11 licen[cs]es?\b"),
    ("apache", "apache", r"\bapache(?: software)? licen[cs]es?\b"),
    ("gpl", "general public", r"\b(?:gnu )?general public licen[cs]es?\b"),
    ("gpl", "gpl", r"\bgnu gpl\b"),
    ("lgpl", "general public", r"\b(?:gnu )?(?:lesser|library) general public licen[cs]es?\b"),
    ("lgpl", "lgpl", r"\b(?:gnu )?lgpl\b"),
    ("agpl-3.0", "affero", r"\b(?:gnu )?affero general public licen[cs]es?\b"),
    ("agpl-3.0", "agpl", r"\b(?:gnu )?agpl\b"),
    ("gfdl", "free documentation", r"\b(?:gnu )?free documentation licen[cs]es?\b"),
    ("bsd", "bsd", r"\bbsd(?:[ -]style)? licen[cs]es?\b"),
    ("isc", "isc", r"\bisc licen[cs]es?\b"),
    ("mpl", "mozilla public", r"\bmozilla public licen[cs]es?\b"),
    ("epl", "eclipse public", r"\beclipse public licen[cs]es?\b"),
    ("cddl", "common development", r"\bcommon development and distribution licen[cs]es?\b"),
    ("eupl", "european union public", r"\beuropean union public licen[cs]es?\b"),
    ("artistic", "artistic", r"\bartistic licen[cs]es?\b"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)? licen[cs]es?\b"),
    ("boost", "boost software", r"\bboost software licen[cs]es?\b"),
    ("unlicense", "unlicense", r"\bthe unlicense\b"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b"),
    ("ofl-1.1", "open font", r"\b(?:sil )?open font licen[cs]es?\b"),
    ("odbl-1.0", "open database", r"\bopen database licen[cs]es?\b"),
    ("python-2.0", "python", r"\bpython software foundation licen[cs]es?\b"),
    ("postgresql", "postgresql", r"\bpostgresql licen[cs]es?\b"),
    ("openssl", "openssl", r"\bopenssl licen[cs]es?\b"),
    ("php", "php", r"\bphp licen[cs]es?\b"),
    ("ruby", "ruby", r"\bruby licen[cs]es?\b"),
    ("sspl-1.0", "server side public", r"\bserver side public licen[cs]es?\b"),
    ("bsl-1.1", "business source", r"\bbusiness source licen[cs]es?\b"),
    ("cc", "creative commons", r"\bcreative commons licen[cs]es?\b"),
)

#: Priority, confidence, rules.
KINDS = ((1, 1.0, BODIES), (2, 0.95, NAMES), (3, 0.9, NOTICES), (4, 0.7, MENTIONS))
