"""License scan: ordered signature rules, gated by keywords, overlaps resolved by priority and containment.

Everything is one narrow projection: no shuffle, no Python, one output row per input row whatever
the skew. A text becomes its canonical form (lower-cased words joined by blanks, a blank at both ends).

1. A super gate (some substrings) lets many texts pass untouched.
2. Of the keywords of the gates that are there, those contained in the text are kept; only their rules are tried.
3. Every match of a tried rule is an interval of the canonical text with the rule's priority.
4. Sorted by (start, longest first, priority, rule order), an interval is dropped if one seen before
   with the same or a better priority reaches its end, i.e. contains it.

Positions and reaches are summed up in two levels (chunks of 256, then their totals), so a text with very many matches
takes time in proportion to them. Null and empty texts have no words and no detections. Repeated rows are scanned each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import canonical, table

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, keyword that every form contains, pattern of the name, pattern of the SPDX identifier, pattern of its address.
FAMILIES = (
    ("mit", "mit", "(?:the )?(?:expat )?mit licen[sc]e", "mit", "opensource org licenses mit"),
    ("mit-0", "mit", "mit (?:no attribution|0)(?: licen[sc]e)?", "mit 0", "opensource org licenses mit 0"),
    ("apache-1.1", "apache", "apache (?:software )?licen[sc]e(?: version)? v?1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?licen[sc]e(?: version)? v?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("gpl-1.0", "gpl", "(?:gnu )?gpl(?: version)? v?1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses gpl 1 0"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?: version)? v?2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses gpl 2 0"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?: version)? v?3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("gpl-2.0", "general public license", "general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?2(?: 0)?", "gnu general public license 2", "gnu general public license v2 html"),
    ("gpl-3.0", "general public license", "general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?3(?: 0)?", "gnu general public license 3", "gnu general public license v3 html"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version)? v?2(?: 1)?", "lgpl 2 1(?: only| or later)?", "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl(?: version)? v?3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("lgpl", "general public license", "(?:lesser|library) general public license", "gnu lesser general public license", "gnu lesser general public license html"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl(?: version)?(?: v?3(?: 0)?)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("agpl-3.0", "general public license", "affero general public license", "gnu affero general public license", "gnu affero general public license html"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)(?: licen[sc]e)?", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[sc]e)?", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[sc]e)?", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause)(?: licen[sc]e)?", "0bsd", "opensource org licenses 0bsd"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]e", "bsd", "opensource org licenses bsd license"),
    ("isc", "isc", "isc licen[sc]e", "isc", "opensource org licenses isc"),
    ("mpl-1.1", "mozilla public license", "mozilla public license(?: version)? v?1 1", "mozilla public license 1 1", "mozilla public license 1 1 html"),
    ("mpl-2.0", "mozilla public license", "mozilla public license(?: version)?(?: v?2(?: 0)?)?", "mozilla public license 2 0", "mozilla public license 2 0 html"),
    ("mpl-2.0", "mpl", "mpl(?: version)? v?2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1.0", "eclipse public license", "eclipse public license(?: version)? v?1(?: 0)?", "eclipse public license 1 0", "eclipse public license v10 html"),
    ("epl-2.0", "eclipse public license", "eclipse public license(?: version)?(?: v?2(?: 0)?)?", "eclipse public license 2 0", "eclipse public license v20 html"),
    ("epl-2.0", "epl", "epl v?2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl-1.0", "cddl", "cddl(?: version)?(?: v?1 0)?", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("cddl-1.0", "common development and distribution license", "common development and distribution license", "common development and distribution license 1 0", "common development and distribution license html"),
    ("artistic-2.0", "artistic", "artistic licen[sc]e(?: version)?(?: v?2(?: 0)?)?", "artistic 2 0", "perlfoundation org artistic"),
    ("bsl-1.0", "boost", "boost software licen[sc]e(?: version)?(?: 1 0)?", "boost 1 0", "boost org license 1 0 txt"),
    ("unlicense", "unlicense", "the unlicense", "unlicense", "unlicense org"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", "zlib", "zlib net zlib license"),
    ("wtfpl", "wtfpl", "wtfpl(?: version)?(?: 2)?(?: licen[sc]e)?", "wtfpl", "wtfpl net"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0", "creativecommons org licenses cc0 1 0"),
    ("cc-by-4.0", "cc by", "cc by(?: licen[sc]e)?(?: [1-4] [05])?", "cc by 4 0", "cc by 4 0 legalcode"),
    ("cc-by-sa-4.0", "cc by sa", "cc by sa(?: licen[sc]e)?(?: [1-4] [05])?", "cc by sa 4 0", "cc by sa 4 0 legalcode"),
    ("cc-by-nc-4.0", "cc by nc", "cc by nc(?: licen[sc]e)?(?: [1-4] [05])?", "cc by nc 4 0", "cc by nc 4 0 legalcode"),
    ("cc-by-nd-4.0", "cc by nd", "cc by nd(?: licen[sc]e)?(?: [1-4] [05])?", "cc by nd 4 0", "cc by nd 4 0 legalcode"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", "cc by nc sa(?: licen[sc]e)?(?: [1-4] [05])?", "cc by nc sa 4 0", "cc by nc sa 4 0 legalcode"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", "cc by nc nd(?: licen[sc]e)?(?: [1-4] [05])?", "cc by nc nd 4 0", "cc by nc nd 4 0 legalcode"),
    ("cc-by-4.0", "creative commons", "creative commons attribution(?: (?:[1-4] [05]|international|unported))* licen[sc]e", "creative commons attribution 4 0", "creative commons attribution html"),
    ("cc-by-sa-4.0", "creative commons", "creative commons attribution share ?alike", "creative commons attribution sharealike 4 0", "creative commons attribution sharealike html"),
    ("cc-by-nc-4.0", "creative commons", "creative commons attribution non ?commercial", "creative commons attribution noncommercial 4 0", "creative commons attribution noncommercial html"),
    ("python-2.0", "python", "python software foundation licen[sc]e(?: version 2)?", "python 2 0", "docs python org license"),
    ("ofl-1.1", "open font", "sil open font licen[sc]e(?: version)?(?: 1 1)?", "sil open font license 1 1", "sil open font license html"),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e", "microsoft public license", "microsoft public license html"),
    ("eupl-1.2", "eupl", "eupl(?: version)?(?: v?1 2)?", "eupl 1 2", "eupl 1 2 en txt"),
    ("eupl-1.2", "european union public", "european union public licen[sc]e", "european union public licence 1 2", "european union public licence html"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql", "postgresql org about licence"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl", "openssl org source license"),
    ("php-3.01", "php", "php licen[sc]e(?: version)?(?: v?3 01)?", "php 3 01", "php net license 3 01 txt"),
    ("ruby", "ruby", "ruby(?: s)? licen[sc]e", "ruby", "ruby lang org en about license"),
    ("vim", "vim", "vim licen[sc]e", "vim", "vim license txt"),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[sc]e", "w3c", "w3c software license html"),
    ("odbl-1.0", "open database", "open database licen[sc]e", "open database license 1 0", "open database license html"),
    ("sspl-1.0", "server side public", "server side public licen[sc]e", "server side public license 1 0", "server side public license html"),
    ("busl-1.1", "business source", "business source licen[sc]e(?: 1 1)?", "business source license 1 1", "business source license html"),
    ("elastic-2.0", "elastic", "elastic licen[sc]e(?: version)?(?: 2(?: 0)?)?", "elastic 2 0", "elastic co licensing elastic license"),
)
#: How a family is cited: priority (0 is best), confidence, pattern; {n} name, {s} identifier, {u} address.
FORMS = (
    (0, 1.0, "spdx licen[sc]e identifier {s}"),
    (1, 0.95, "(?:https? )?(?:www )?{u}"),
    (1, 0.9, "(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?{n}"),
    (2, 0.8, "{n}"),
)
#: Clauses of license texts and notices: label, keyword, priority, confidence, pattern.
CLAUSES = (
    ("mit", "permission is hereby granted", 1, 0.95, "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("isc", "permission to use", 1, 0.95, "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use", 1, 0.9, "redistribution and use in source and binary forms with or without modification(?: are permitted)?"),
    ("bsd-2-clause", "redistributions of source code", 2, 0.7, "redistributions of source code must retain the above copyright notice"),
    ("bsd-2-clause", "redistributions in binary form", 2, 0.7, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name", 1, 0.9, "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors"),
    ("bsd-4-clause", "advertising materials", 1, 0.9, "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "limitations under the license", 2, 0.8, "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "in compliance with the license", 2, 0.7, "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software", 1, 0.9, "this program is free software you can redistribute it and or modify it"),
    ("gpl", "free software foundation", 3, 0.5, "(?:published by )?the free software foundation"),
    ("gpl", "gnu gpl", 3, 0.6, "gnu gpl"),
    ("gpl", "general public license", 3, 0.6, "(?:gnu )?general public license"),
    ("lgpl", "this library is free software", 1, 0.9, "this library is free software you can redistribute it and or modify it"),
    ("agpl-3.0", "remote network interaction", 2, 0.8, "remote network interaction"),
    ("apache", "apache licen", 3, 0.6, "apache licen[sc]e"),
    ("apache", "apache licensed", 3, 0.5, "apache licensed"),
    ("mit", "mit licensed", 3, 0.6, "mit licensed"),
    ("mpl-2.0", "source code form is subject", 1, 0.95, "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "free and unencumbered", 1, 0.95, "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", 2, 0.7, "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", 3, 0.4, "public domain"),
    ("zlib", "in no event will the authors", 1, 0.8, "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered source versions", 2, 0.8, "altered source versions must be plainly marked as such"),
    ("bsl-1.0", "obtaining a copy of the software and accompanying documentation", 1, 0.9, "obtaining a copy of the software and accompanying documentation covered by this license"),
    ("wtfpl", "what the fuck", 1, 0.9, "do what the fuck you want to public license"),
    ("cc", "creative commons", 3, 0.5, "creative commons(?: licen[sc]e)?"),
    ("proprietary", "all rights reserved", 2, 0.7, "all rights reserved"),
    ("proprietary", "proprietary and confidential", 1, 0.9, "proprietary and confidential"),
    ("proprietary", "unauthorized copying", 1, 0.9, "unauthorized copying of this file"),
    ("proprietary", "end user licen", 2, 0.7, "end user licen[sc]e agreement"),
    ("copyright", "copyright", 3, 0.3, "copyright(?: c)?(?: [12][0-9]{3})+"),
    ("warranty", "without warranty", 3, 0.3, "without warranty of any kind"),
    ("warranty", "as is", 3, 0.3, "provided (?:on an )?as is(?: basis)?(?: without warranty)?"),
    ("dual", "dual licensed", 2, 0.6, "dual licensed under"),
    ("beerware", "beer", 1, 0.9, "the beer ?ware licen[sc]e"),
    ("json", "good not evil", 1, 0.95, "shall be used for good not evil"),
    ("contributor-agreement", "contributor licen", 2, 0.6, "contributor licen[sc]e agreement"),
    ("see-license", "license file", 3, 0.2, "see (?:the )?(?:accompanying )?license file"),
    ("generic", "under the license", 3, 0.2, "under the license"),
    ("generic", "licensed under", 3, 0.2, "licensed under"),
    ("mit", "substantial portions of the software", 1, 0.9, "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "without restriction including without limitation", 2, 0.8, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "the software is furnished to do so", 3, 0.6, "and to permit persons to whom the software is furnished to do so"),
    ("mit", "merchantability fitness for a particular purpose and noninfringement", 2, 0.7, "(?:including but not limited to )?the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "action of contract tort or otherwise", 3, 0.6, "whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    ("x11", "shall not be used in advertising", 1, 0.9, "except as contained in this notice the names? of (?:[^ ]+ ){1,12}shall not be used in advertising or otherwise to promote the sale"),
    ("x11", "x consortium", 2, 0.7, "the x consortium"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee", 1, 0.9, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "author disclaims all warranties", 2, 0.8, "the software is provided as is and the author disclaims all warranties"),
    ("isc", "author be liable for any special direct", 3, 0.7, "in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("hpnd", "in all copies", 2, 0.6, "provided that the above copyright notice appears? in all copies"),
    ("hpnd", "in supporting documentation", 2, 0.7, "that both (?:that|the) copyright notice and this permission notice appear in supporting documentation"),
    ("hpnd", "specific written prior permission", 2, 0.7, "without specific written prior permission"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation", 1, 0.8, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "are permitted provided that the following conditions are met", 2, 0.8, "are permitted provided that the following conditions are met"),
    ("bsd", "this list of conditions", 3, 0.6, "this list of conditions and the following disclaimer"),
    ("bsd", "documentation and or other materials provided", 3, 0.6, "in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "endorse or promote products", 2, 0.8, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "copyright holders and contributors as is", 2, 0.8, "this software is provided by the copyright holders and contributors as is"),
    ("bsd", "regents and contributors as is", 1, 0.9, "this software is provided by the regents and contributors as is"),
    ("bsd", "regents of the university of california", 2, 0.7, "the regents of the university of california"),
    ("bsd", "procurement of substitute goods", 3, 0.6, "procurement of substitute goods or services loss of use data or profits"),
    ("bsd", "however caused and on any theory of liability", 3, 0.6, "however caused and on any theory of liability whether in contract strict liability or tort"),
    ("bsd-4-clause", "this product includes software developed by", 2, 0.8, "this product includes software developed by"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent", 1, 0.95, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-patent", "each copyright holder and contributor hereby grants", 1, 0.9, "each copyright holder and contributor hereby grants to those receiving rights under this license"),
    ("apache-2.0", "licensed under the apache license", 1, 0.9, "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing", 2, 0.8, "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2.0", "without warranties or conditions of any kind", 2, 0.8, "without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "contributor license agreements see the notice file", 1, 0.9, "licensed to the apache software foundation(?: asf)? under one or more contributor license agreements see the notice file"),
    ("apache-2.0", "grant of patent license subject to", 1, 0.9, "grant of patent license subject to the terms and conditions of this license"),
    ("apache-2.0", "terms and conditions for use reproduction and distribution", 1, 0.9, "terms and conditions for use reproduction and distribution"),
    ("apache-1.1", "this product includes software developed by the apache", 1, 0.9, "this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl", "under the terms of the gnu general public license", 1, 0.9, "under the terms of the gnu general public license"),
    ("gpl", "without even the implied warranty", 2, 0.8, "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "you should have received a copy of the gnu", 2, 0.8, "you should have received a copy of the gnu (?:lesser |library |affero )?general public license"),
    ("gpl", "51 franklin", 3, 0.6, "51 franklin (?:street|st) fifth floor boston"),
    ("gpl", "59 temple place", 3, 0.6, "59 temple place suite 330 boston"),
    ("gpl", "either version", 3, 0.6, "either version [123](?: 1| 0)? of the license or at your option any later version"),
    ("gpl", "absolutely no warranty", 2, 0.7, "comes with absolutely no warranty"),
    ("gpl", "everyone is permitted to copy", 1, 0.9, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2.0", "because the program is licensed free of charge", 1, 0.9, "because the program is licensed free of charge there is no warranty for the program"),
    ("gpl-2.0", "your freedom to share and change", 1, 0.9, "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "free copyleft license for software", 1, 0.95, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "there is no warranty for the program to the extent permitted", 1, 0.9, "there is no warranty for the program to the extent permitted by applicable law"),
    ("gpl-3.0", "installation information", 3, 0.4, "installation information for a user product"),
    ("gpl-exception", "as a special exception", 2, 0.6, "as a special exception"),
    ("classpath-exception", "linking this library statically or dynamically", 1, 0.9, "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("lgpl", "under the terms of the gnu l", 1, 0.95, "under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "work that uses the library", 2, 0.7, "work that uses the library"),
    ("agpl-3.0", "under the terms of the gnu affero general public license", 1, 0.95, "under the terms of the gnu affero general public license"),
    ("agpl-3.0", "interacting with it remotely through a computer network", 1, 0.95, "all users interacting with it remotely through a computer network"),
    ("gfdl", "free documentation license", 1, 0.95, "(?:gnu )?free documentation license(?: version 1 [1-3])?"),
    ("gfdl", "no invariant sections", 1, 0.9, "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "if a copy of the mpl was not distributed", 1, 0.95, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "incompatible with secondary licenses", 1, 0.9, "incompatible with secondary licenses"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license", 1, 0.95, "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl-1.1", "the initial developer of the original code", 2, 0.8, "the initial developer of the original code is"),
    ("epl", "this program and the accompanying materials are made available under", 1, 0.9, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "recipient s acceptance of this agreement", 2, 0.7, "constitutes recipient s acceptance of this agreement"),
    ("cpl-1.0", "common public license", 1, 0.9, "common public license(?: version)?(?: v?1 0)?"),
    ("ipl-1.0", "ibm public license", 1, 0.9, "ibm public license(?: version)?(?: v?1 0)?"),
    ("cddl-1.0", "subject to the terms of the common development", 1, 0.95, "subject to the terms of the common development and distribution license"),
    ("artistic-1.0", "semblance of artistic control", 1, 0.95, "such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "the intent is that the copyright holder maintains some artistic control", 1, 0.95, "the intent is that the copyright holder maintains some artistic control over the development of that package"),
    ("perl", "same terms as perl", 1, 0.95, "under the same terms as perl(?: itself)?"),
    ("python-2.0", "psf license agreement", 1, 0.9, "psf license agreement for python"),
    ("python-2.0", "python software foundation psf is making python available", 1, 0.9, "(?:the )?python software foundation psf is making python available to licensee"),
    ("zlib", "the origin of this software must not be misrepresented", 1, 0.95, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "may not be removed or altered from any source distribution", 2, 0.9, "this notice may not be removed or altered from any source distribution"),
    ("zlib", "including commercial applications", 2, 0.8, "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("libpng", "png reference library", 1, 0.8, "the png reference library is supplied as is"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization", 1, 0.9, "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("bsl-1.0", "machine executable object code", 2, 0.8, "solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", "anyone is free to copy modify publish use compile sell", 1, 0.95, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "dedicate any and all copyright interest", 1, 0.95, "dedicate any and all copyright interest in the software to the public domain"),
    ("cc0-1.0", "waived all copyright and related", 1, 0.95, "(?:has )?waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "public domain dedication", 1, 0.9, "(?:cc0 1 0 universal )?public domain dedication"),
    ("cc-by-4.0", "creative commons attribution", 2, 0.8, "creative commons attribution (?:4 0|3 0|2 [05])"),
    ("cc-by-sa-4.0", "attribution share", 1, 0.85, "attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-4.0", "attribution noncommercial", 1, 0.85, "attribution noncommercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nd-4.0", "attribution no", 1, 0.85, "attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-nc-sa-4.0", "attribution noncommercial sharealike", 0, 0.9, "attribution noncommercial sharealike(?: [1-4] [05])?"),
    ("cc-by-nc-nd-4.0", "attribution noncommercial noderivatives", 0, 0.9, "attribution noncommercial noderivatives(?: [1-4] [05])?"),
    ("ofl-1.1", "reserved font name", 1, 0.9, "(?:with )?reserved font names?"),
    ("ofl-1.1", "font software", 3, 0.6, "the font software may be (?:modified|sold|bundled)"),
    ("ms-pl", "microsoft public license ms pl", 0, 0.95, "microsoft public license ms pl"),
    ("ms-rl", "microsoft reciprocal", 1, 0.9, "microsoft reciprocal licen[sc]e"),
    ("eupl-1.2", "licensed under the eupl", 1, 0.95, "licensed under the eupl"),
    ("postgresql", "postgresql database management system", 2, 0.8, "postgresql database management system"),
    ("openssl", "for use in the openssl toolkit", 1, 0.95, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", 1, 0.8, "this product includes cryptographic software written by eric young"),
    ("php-3.01", "this product includes php software", 1, 0.9, "this product includes php software freely available from"),
    ("w3c", "w3c document licen", 1, 0.9, "w3c document licen[sc]e"),
    ("odc-by-1.0", "open data commons attribution", 1, 0.9, "open data commons attribution licen[sc]e"),
    ("pddl-1.0", "public domain dedication and licen", 0, 0.9, "(?:open data commons )?public domain dedication and licen[sc]e"),
    ("odbl-1.0", "made available under the open database", 1, 0.95, "made available under the open database licen[sc]e"),
    ("cdla-permissive", "community data license agreement permissive", 1, 0.9, "community data license agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing", "community data license agreement sharing", 1, 0.9, "community data license agreement sharing(?: version)?(?: 1 0)?"),
    ("sspl-1.0", "making the functionality of the program available to third parties as a service", 1, 0.9, "making the functionality of the program available to third parties as a service"),
    ("busl-1.1", "change date", 2, 0.7, "additional use grant (?:[^ ]+ ){0,12}change date"),
    ("elastic-2.0", "hosted or managed service", 1, 0.9, "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", 1, 0.9, "commons clause licen[sc]e condition(?: v?1 0)?"),
    ("polyform", "polyform", 1, 0.9, "polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[sc]e"),
    ("prosperity", "prosperity public", 1, 0.9, "(?:the )?prosperity public licen[sc]e"),
    ("parity", "parity public", 1, 0.9, "(?:the )?parity public licen[sc]e"),
    ("blueoak-1.0.0", "blue oak model", 1, 0.95, "blue oak model licen[sc]e(?: 1 0 0)?"),
    ("mulan-psl-2.0", "mulan permissive", 1, 0.95, "mulan permissive software licen[sc]e(?: version 2| v2)?"),
    ("upl-1.0", "universal permissive", 1, 0.9, "universal permissive licen[sc]e(?: v?1 0)?"),
    ("ncsa", "university of illinois ncsa", 1, 0.95, "university of illinois ncsa open source licen[sc]e"),
    ("afl-3.0", "academic free", 1, 0.9, "academic free licen[sc]e(?: version)?(?: v?[123] [01])?"),
    ("osl-3.0", "open software licen", 1, 0.9, "open software licen[sc]e(?: version)?(?: v?[123] [01])?"),
    ("qpl-1.0", "q public", 1, 0.9, "q public licen[sc]e(?: version)?(?: 1 0)?"),
    ("lppl", "latex project public", 1, 0.95, "latex project public licen[sc]e(?: version)?(?: 1 [0-3]c?)?"),
    ("cecill", "cecill", 1, 0.9, "cecill(?: [bc])?(?: free software)? licen[sc]e(?: agreement)?"),
    ("sleepycat", "sleepycat", 1, 0.9, "sleepycat (?:software|licen[sc]e)"),
    ("zpl-2.1", "zope public", 1, 0.95, "zope public licen[sc]e(?: zpl)?(?: version)?(?: 2 [01])?"),
    ("tcl", "the authors hereby grant permission to use copy modify", 1, 0.9, "the authors hereby grant permission to use copy modify distribute and license this software"),
    ("icu", "icu licen", 1, 0.9, "icu licen[sc]e"),
    ("unicode", "unicode data files and", 1, 0.9, "(?:a copy of )?the unicode data files and any associated documentation"),
    ("ijg", "independent jpeg group", 1, 0.9, "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype project", 1, 0.9, "portions of this software are copyright (?:c )?[12][0-9]{3} the freetype project"),
    ("rail", "openrail", 1, 0.9, "(?:creativeml |bigscience )?openrail [ms]"),
    ("llama", "llama 2 community licen", 1, 0.9, "llama 2 community licen[sc]e(?: agreement)?"),
    ("research-only", "research purposes only", 2, 0.7, "for (?:non ?commercial )?research purposes only"),
    ("non-commercial", "non commercial use only", 2, 0.7, "for non commercial use only"),
    ("non-commercial", "commercial use is prohibited", 2, 0.8, "commercial use is prohibited"),
    ("no-redistribution", "may not be redistributed", 2, 0.7, "may not be redistributed"),
    ("proprietary", "strictly prohibited", 2, 0.7, "(?:reproduction|copying|distribution|use) (?:[^ ]+ ){0,8}is strictly prohibited"),
    ("proprietary", "trade secret", 2, 0.7, "contains? (?:confidential information and )?trade secrets?"),
    ("proprietary", "prior written consent", 3, 0.5, "without the (?:express )?prior written consent of"),
    ("proprietary", "for internal use only", 2, 0.7, "for internal use only"),
    ("contributor-agreement", "certificate of origin", 1, 0.9, "developer(?: s)? certificate of origin"),
    ("warranty", "at your own risk", 3, 0.3, "use (?:it )?at your own risk"),
    ("warranty", "no warranty", 3, 0.3, "(?:there is )?no warranty"),
    ("dual", "under either of", 2, 0.5, "licensed under either of"),
    ("dual", "at your option", 3, 0.3, "at your option"),
    ("patent", "patent rights", 3, 0.3, "additional grant of patent rights"),
)
#: Every keyword's text contains one of these.
SUPER_GATE = (
    "licen", "copyright", "permi", "redistribut", "public", "free software", "gpl", "bsd", "mit ", "apache", "mpl", "epl", "cddl",
    "artistic", "boost", "isc ", "zlib", "wtfpl", "cc0", "cc by", "creative commons", "python", "font", "eupl", "postgresql", "openssl",
    "php", "ruby", "vim", "w3c", "database", "business source", "elastic", "advertising", "neither the name", "network interaction",
    "unencumbered", "in no event", "altered source", "obtaining a copy", "what the", "rights reserved", "proprietary", "unauthorized",
    "end user", "warrant", "as is", "beer", "good not evil", "mozilla", "eclipse", "microsoft", "source code form", "without restriction",
    "of the software", "merchantab", "tort", "x consortium", "disclaims", "liable", "in all copies", "supporting doc", "written prior", "written consent",
    "conditions", "documentation", "endorse or", "regents", "substitute goods", "liability", "patent", "product includes", "required by applicable",
    "gnu", "51 franklin", "59 temple", "either version", "your freedom", "copyleft", "installation info", "special exception", "linking this", "the library",
    "remotely through", "invariant", "original code", "accompanying", "recipient s", "same terms", "psf", "misrepresented", "commercial", "png ref",
    "machine exec", "anyone is free", "attribution", "reserved font", "eric young", "open data", "as a service", "change date", "managed service", "commons clause",
    "polyform", "blue oak", "university of", "academic free", "cecill", "sleepycat", "authors hereby", "unicode data", "jpeg group", "freetype",
    "openrail", "research purposes", "redistributed", "strictly", "trade secret", "internal use", "certificate of", "own risk", "under either", "your option", "because the", "common development", "removed or altered", "furnished to",
)
LEVELS = 4


def rules() -> list[tuple[str, str, int, float, str]]:
    """label, keyword, priority, confidence, pattern; in rule order."""
    made = [
        (label, keyword, priority, confidence, form.format(n=f"(?:{name})", s=spdx, u=url))
        for label, keyword, name, spdx, url in FAMILIES
        for priority, confidence, form in FORMS
    ]
    return [*made, *CLAUSES]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_literal(all_rules) -> str:
    """The rules as an SQL literal: array of (gate, kws: array of (kw, rules array)), so that only keywords of gates that are there are tried."""
    by: dict[str, dict[str, list[str]]] = {}
    for order, (label, keyword, priority, confidence, pattern) in enumerate(all_rules):
        gate = next(g for g in SUPER_GATE if g in keyword or g in f" {keyword} ")
        by.setdefault(gate, {}).setdefault(keyword, []).append(
            f"named_struct('label',{_quoted(label)},'prio',{priority},'ord',{order},'conf',{confidence}D,"
            f"'re',{_quoted('(?<= )' + pattern.rstrip() + '(?= )')})"
        )
    words = lambda kws: ",".join(f"named_struct('kw',{_quoted(k)},'rules',array({','.join(v)}))" for k, v in kws.items())
    return "array(" + ",".join(f"named_struct('gate',{_quoted(g)},'kws',array({words(kws)}))" for g, kws in by.items()) + ")"


CHUNK = 256  # of the arrays that are worked on in two levels
FOUND = "array<struct<s:int,ne:int,prio:int,ord:int,label:string,conf:double>>"


def _chunks(x: str) -> str:
    return f"transform(if(size({x}) = 0, array(), sequence(0, (size({x}) - 1) div {CHUNK})), c_ -> slice({x}, c_ * {CHUNK} + 1, {CHUNK}))"


def _sums_before(lengths: str) -> str:
    """Of an array of lengths, the sum before each: inside chunks, and over the chunks' totals, so work is nearly linear."""
    inner = f"transform({_chunks(lengths)}, x_ -> aggregate(x_, array(0), (a_, v_) -> concat(a_, array(element_at(a_, -1) + v_))))"
    totals = "aggregate(in_, array(0), (a_, x_) -> concat(a_, array(element_at(a_, -1) + element_at(x_, -1))))"
    return (
        f"flatten(transform(array({inner}), in_ -> flatten(transform(array({totals}), t_ -> "
        f"flatten(transform(in_, (x_, i_) -> transform(slice(x_, 1, size(x_) - 1), v_ -> v_ + t_[i_])))))))"
    )


def _found(canon: str, all_rules) -> Column:
    """Array of (s, ne, prio, ord, label, conf): each match of each tried rule; ne is the negated end."""
    at = _sums_before("transform(x.m, (m_, j_) -> length(x.p[j_]) + length(m_))")
    one = (
        f"flatten(transform(array(named_struct('p', split({canon}, r.re, -1), 'm', regexp_extract_all({canon}, r.re, 0))), x -> "
        f"if(size(x.m) = 0, cast(array() as {FOUND}), transform({at}, (b, i) -> named_struct("
        "'s', b + length(x.p[i]), 'ne', -(b + length(x.p[i]) + length(x.m[i])), "
        "'prio', r.prio, 'ord', r.ord, 'label', r.label, 'conf', r.conf)))))"
    )
    tried = f"flatten(transform(filter({_rule_literal(all_rules)}, g -> contains({canon}, g.gate)), g -> filter(g.kws, k -> contains({canon}, k.kw))))"
    return F.expr(f"flatten(transform({tried}, k -> flatten(transform(k.rules, r -> {one}))))")


def _resolved(found: str) -> Column:
    """Containment suppression over the sorted intervals; state is one reach per priority.

    A dropped interval doesn't change any reach, so reaches are running maxima: first of chunks, then inside them.
    """
    levels = ",".join(f"coalesce(array_max(transform(filter(x_, d -> d.prio <= {k}), d -> -d.ne)), -1)" for k in range(LEVELS))
    before = (
        f"aggregate(transform(ch_, x_ -> array({levels})), array(array({','.join(['-1'] * LEVELS)})), "
        "(a_, t_) -> concat(a_, array(zip_with(element_at(a_, -1), t_, (p_, q_) -> greatest(p_, q_)))))"
    )
    inside = (
        f"aggregate(x_, named_struct('reach', b_[i_], 'out', cast(array() as {FOUND})), "
        "(a, d) -> if(a.reach[d.prio] >= -d.ne, a, named_struct("
        "'reach', transform(a.reach, (r, i) -> if(i >= d.prio, greatest(r, -d.ne), r)), 'out', concat(a.out, array(d)))), "
        "a -> transform(a.out, d -> named_struct('start', d.s - 1, 'end', -d.ne - 1, 'label', d.label, 'rule', d.ord, 'confidence', d.conf)))"
    )
    return F.expr(
        f"flatten(transform(array(array_sort({found})), s_ -> flatten(transform(array({_chunks('s_')}), ch_ -> "
        f"flatten(transform(array({before}), b_ -> flatten(transform(ch_, (x_, i_) -> {inside}))))))))"
    )


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, base (label array, places, first and last word) and detections to each row.

    detections: array of (start, end, label, rule, confidence), offsets in the canonical text, after suppression.
    Columns of ``df`` with the names of added ones are replaced.
    """
    phrases = "|".join(p for p, _ in BASE)
    words = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" ")))  # noqa: E731  each word has one blank behind it
    canon, split, found = (_unused(df, x) for x in ("canon", "split", "found"))
    out = df.withColumn(canon, F.concat(F.lit(" "), canonical(F.col(text)), F.lit(" ")))
    gate = F.lit(False)
    for part in SUPER_GATE:
        gate = gate | F.contains(F.col(canon), F.lit(part))
    base_gate = F.lit(False)
    for phrase, _ in BASE:
        base_gate = base_gate | F.contains(F.col(canon), F.lit(f" {phrase} "))
    # a blank starts the canonical text, so the piece before a place has a blank before each of its words
    out = out.withColumn(split, F.when(base_gate, F.split(canon, f" (?=(?:{phrases}) )", -1)))
    out = out.withColumn("n_words", F.when(F.trim(canon) == "", 0).otherwise(words(F.col(canon)) - 1).cast("long"))
    out = out.withColumn("n_base", F.coalesce(F.size(split) - 1, F.lit(0)).cast("long"))
    out = out.withColumn("first_word", F.when(F.col("n_base") > 0, words(F.element_at(split, 1))).cast("long"))
    # the last piece starts at a word and ends with the closing blank: as many blanks as words
    out = out.withColumn("last_word", F.when(F.col("n_base") > 0, F.col("n_words") - words(F.element_at(split, -1))).cast("long"))
    hits = [F.when(F.contains(F.col(canon), F.lit(f" {p} ")), F.lit(label)) for p, label in BASE]
    out = out.withColumn("base_label_list", F.array_sort(F.array_compact(F.array(*hits))))
    out = out.withColumn(found, F.when(gate, _found(canon, rules())).otherwise(F.array().cast(FOUND)))
    return out.withColumn("detections", _resolved(found)).drop(canon, split, found)


def _unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Base places and labels per document; labels adds those of the detections that survive."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.array_sort(F.array_union("base_label_list", F.transform("detections", lambda d: d["label"])))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_label_list", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, 0.6).otherwise(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE: dict[str, str] = {}
