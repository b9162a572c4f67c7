"""Hand-written signatures of license texts and notices, over lower-cased words joined by single spaces.

Fixed values: sentences and headings as the licenses themselves and their usual notices word them.
"""

#: label, regex, keyword (a word that every match holds; several as alternatives).
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "permission"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "merchantability"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "liability"),
    ("mit", "this (?:project|software|library|package|code|work) is (?:licensed|released|distributed|available) under the terms of the mit licen[sc]e", "mit"),
    ("mit-0", "mit no attribution(?: licen[sc]e)?", "attribution"),
    ("mit-cmu", "permission to use copy modify and distribute this software and its associated documentation for any purpose and without fee is hereby granted", "documentation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission"),
    ("isc", "the author disclaims all warranties with regard to this software including all implied warranties", "disclaims"),
    ("0bsd", "(?:bsd zero clause|zero clause bsd|free public) licen[sc]e", "bsd|free"),
    ("hpnd", "historical permission notice and disclaimer", "disclaimer"),
    ("ntp", "network time protocol licen[sc]e", "protocol"),
    ("x11", "x11 licen[sc]e", "x11"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising", "consortium"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions", "redistributions"),
    ("bsd", "use of this source code is governed by a bsd style licen[sc]e that can be found in the licen[sc]e file", "bsd"),
    ("bsd-2-clause", "(?:simplified bsd|free ?bsd) licen[sc]e", "bsd|freebsd"),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse", "endorse"),
    ("bsd-3-clause", "the names? of the (?:author|authors|contributors|copyright holders?) may not be used to endorse or promote products", "endorse"),
    ("bsd-3-clause", "(?:new|modified|revised) bsd licen[sc]e", "bsd"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising"),
    ("bsd-4-clause", "(?:original|old) bsd licen[sc]e", "bsd"),
    ("bsd-3-clause-clear", "clear bsd licen[sc]e", "bsd"),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledge?ment", "redistribution"),
    ("apache-2", "licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance", "apache"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", "applicable"),
    ("apache-2", "see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e", "governing"),
    ("apache-2", "terms and conditions for use reproduction and distribution 1 definitions", "reproduction"),
    ("apache-2", "apache org licenses licen[sc]e 2 0", "apache"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", "redistribute"),
    ("gpl", "you should have received a copy of the gnu general public licen[sc]e along with this (?:program|software|file|package)", "received"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "hope"),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it", "freedom"),
    ("gpl-1", "gnu general public licen[sc]e version 1 february 1989", "1989"),
    ("gpl-2", "gnu general public licen[sc]e version 2 june 1991", "1991"),
    ("gpl-2", "(?:either )?version 2 (?:of the licen[sc]e )?or at your option any later version", "option"),
    ("gpl-3", "gnu general public licen[sc]e version 3 29 june 2007", "2007"),
    ("gpl-3", "(?:either )?version 3 (?:of the licen[sc]e )?or at your option any later version", "option"),
    ("gpl-3", "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", "copyleft"),
    ("gpl-2-with-classpath-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library", "linking"),
    ("gpl-2-with-classpath-exception", "gnu classpath exception", "classpath"),
    ("gpl-3-with-gcc-exception", "gcc runtime library exception", "gcc"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", "redistribute"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this library", "received"),
    ("lgpl-2", "gnu library general public licen[sc]e version 2 june 1991", "1991"),
    ("lgpl-2.1", "gnu lesser general public licen[sc]e version 2 1 february 1999", "1999"),
    ("lgpl-3", "this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3", "incorporates"),
    ("agpl-3", "gnu affero general public licen[sc]e version 3 19 november 2007", "affero"),
    ("agpl-3", "the gnu affero general public licen[sc]e is a free copyleft licen[sc]e for software", "affero"),
    ("agpl", "you should have received a copy of the gnu affero general public licen[sc]e", "affero"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", "documentation"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", "invariant"),
    ("sspl-1", "server side public licen[sc]e(?: version 1| v1)?", "server"),
    ("busl-1.1", "business source licen[sc]e(?: 1 1)?", "business"),
    ("busl-1.1", "the licensor may make an additional use grant above permitting limited production use", "licensor"),
    ("elastic-2", "elastic licen[sc]e (?:version )?2(?: 0)?", "elastic"),
    ("commons-clause", "commons clause (?:licen[sc]e )?condition", "clause"),
    ("commons-clause", "the licen[sc]e does not grant to you the right to sell the software", "sell"),
    ("polyform-noncommercial", "polyform noncommercial licen[sc]e", "polyform"),
    ("polyform-small-business", "polyform small business licen[sc]e", "polyform"),
    ("prosperity", "prosperity public licen[sc]e", "prosperity"),
    ("parity", "parity public licen[sc]e", "parity"),
    ("fsl", "functional source licen[sc]e", "functional"),
    ("hippocratic", "hippocratic licen[sc]e", "hippocratic"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1", "mozilla"),
    ("mpl-1", "the contents of this file are subject to the mozilla public licen[sc]e version 1 0", "mozilla"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", "mozilla"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("mpl-2-no-copyleft-exception", "this source code form is incompatible with secondary licenses", "secondary"),
    ("npl", "netscape public licen[sc]e", "netscape"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "development"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "eclipse"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public licen[sc]e", "eclipse"),
    ("edl", "eclipse distribution licen[sc]e", "eclipse"),
    ("cpl", "the accompanying program is provided under the terms of this common public licen[sc]e", "accompanying"),
    ("ipl", "ibm public licen[sc]e", "ibm"),
    ("eupl", "licensed under the eupl", "eupl"),
    ("cecill", "cecill(?: [abc])? (?:free software )?licen[sc]e", "cecill"),
    ("cecill", "this software is governed by the cecill(?: [abc])? licen[sc]e under french law", "cecill"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented"),
    ("libpng", "libpng licen[sc]e", "libpng"),
    ("bzip2", "bzip2 (?:and libbzip2 )?licen[sc]e", "bzip2"),
    ("curl", "curl licen[sc]e", "curl"),
    ("libtiff", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "sell"),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "jpeg"),
    ("freetype", "free ?type (?:project )?licen[sc]e", "freetype|type"),
    ("freetype", "portions of this software are copyright .{0,40}?the freetype project", "freetype"),
    ("icu", "icu licen[sc]e", "icu"),
    ("unicode", "unicode (?:data files and software )?licen[sc]e(?: agreement)?", "unicode"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "permission"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone"),
    ("wtfpl", "you just do what the fuck you want to", "fuck"),
    ("beerware", "beer ?ware licen[sc]e", "beerware|beer"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", "beer"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "intent"),
    ("artistic-1-perl", "under the same terms as perl itself", "perl"),
    ("artistic-2", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed", "verbatim"),
    ("ruby", "ruby licen[sc]e", "ruby"),
    ("php", "php licen[sc]e(?: version)? 3(?: 0| 01)?", "php"),
    ("php", "this product includes php software freely available from", "php"),
    ("psf", "python software foundation licen[sc]e(?: version 2)?", "python"),
    ("psf", "psf is making python available to licensee on an as is basis", "psf"),
    ("cnri-python", "cnri (?:open source )?(?:python )?licen[sc]e(?: agreement)?", "cnri"),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and licen[sc]e this software and its documentation", "authors"),
    ("vim", "vim licen[sc]e", "vim"),
    ("lppl", "latex project public licen[sc]e", "latex"),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public licen[sc]e", "latex"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"),
    ("ssleay", "this product includes cryptographic software written by eric young", "cryptographic"),
    ("w3c", "w3c software (?:and document )?notice and licen[sc]e", "w3c"),
    ("w3c", "w3c software licen[sc]e", "w3c"),
    ("ofl", "this font software is licensed under the sil open font licen[sc]e", "font"),
    ("ofl", "the fonts? (?:and derivatives )?may be (?:bundled embedded )?redistributed", "redistributed"),
    ("ofl", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", "font"),
    ("ubuntu-font", "ubuntu font licen[sc]e", "ubuntu"),
    ("bitstream-vera", "bitstream vera (?:fonts? )?(?:copyright|licen[sc]e)", "bitstream"),
    ("ncsa", "university of illinois ncsa open source licen[sc]e", "ncsa"),
    ("ms-pl", "microsoft public licen[sc]e ms pl", "microsoft"),
    ("ms-rl", "microsoft reciprocal licen[sc]e ms rl", "microsoft"),
    ("ms-eula", "microsoft software licen[sc]e terms", "microsoft"),
    ("ms-lpl", "microsoft limited public licen[sc]e", "microsoft"),
    ("apsl", "apple public source licen[sc]e", "apple"),
    ("apple-sample", "apple sample code licen[sc]e", "apple"),
    ("oracle-bcl", "oracle binary code licen[sc]e agreement", "oracle"),
    ("oracle-otn", "oracle technology network licen[sc]e agreement", "oracle"),
    ("sun-industry", "sun industry standards source licen[sc]e", "sun"),
    ("intel-simplified", "intel simplified software licen[sc]e", "intel"),
    ("nvidia-eula", "nvidia (?:software )?(?:end user )?licen[sc]e agreement", "nvidia"),
    ("nvidia-source", "nvidia source code licen[sc]e", "nvidia"),
    ("qpl", "q public licen[sc]e", "public"),
    ("sleepycat", "sleepycat (?:software )?licen[sc]e", "sleepycat"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", "accompanied"),
    ("ecl-2", "educational community licen[sc]e(?: version)? 2(?: 0)?", "educational"),
    ("rpl", "reciprocal public licen[sc]e", "reciprocal"),
    ("watcom", "sybase open watcom public licen[sc]e", "watcom"),
    ("zpl", "zope public licen[sc]e", "zope"),
    ("vostrom", "vostrom public licen[sc]e", "vostrom"),
    ("json", "the software shall be used for good not evil", "evil"),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0"),
    ("cc0", "creative commons (?:zero|0)", "commons"),
    ("cc0", "to the extent possible under law .{1,80}? has waived all copyright and related or neighbo[u]?ring rights", "waived"),
    ("cc", "this work is licensed under a creative commons .{0,80}?licen[sc]e", "commons"),
    ("cc", "creativecommons org licenses (?:by|by sa|by nc|by nd|by nc sa|by nc nd) [1-4] [05]", "creativecommons"),
    ("cc-pdm", "public domain mark(?: 1 0)?", "mark"),
    ("odbl", "made available under the open database licen[sc]e", "database"),
    ("odc-by", "open data commons attribution licen[sc]e", "commons"),
    ("pddl", "open data commons public domain dedication", "commons"),
    ("cdla-permissive", "community data licen[sc]e agreement permissive", "permissive"),
    ("cdla-sharing", "community data licen[sc]e agreement sharing", "sharing"),
    ("ogl-uk", "open government licen[sc]e(?: v?[1-3](?: 0)?)?", "government"),
    ("ogl-uk", "contains public sector information licensed under the open government licen[sc]e", "government"),
    ("etalab-2", "licence ouverte(?: open licen[sc]e)?(?: 2 0)?", "ouverte"),
    ("dl-de-by", "data ?licen[cs]e germany attribution", "germany"),
    ("fal", "free art licen[sc]e", "art"),
    ("d-fsl", "deutsche freie software lizenz", "lizenz"),
    ("llama", "llama (?:[0-9] )?(?:[0-9] )?community licen[sc]e agreement", "llama"),
    ("gemma", "gemma terms of use", "gemma"),
    ("openrail", "creativeml open ?rail (?:m|plus plus)(?: licen[sc]e)?", "creativeml"),
    ("ai2-impact", "ai2 impact licen[sc]e", "ai2"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "domain"),
    ("public-domain", "(?:this (?:file|work|code|software|text) is )?in the public domain", "domain"),
    ("public-domain", "public domain dedication", "domain"),
    ("public-domain", "no copyright (?:is claimed|protection is available) (?:in|for|under)", "copyright"),
    ("proprietary", "all rights reserved", "reserved"),
    ("proprietary", "proprietary and confidential", "proprietary"),
    ("proprietary", "confidential and proprietary", "proprietary"),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|document|work|software|material)", "unauthorized|unauthorised"),
    ("proprietary", "may not be (?:copied|reproduced|distributed|used) without (?:the )?(?:prior |express )*(?:written )?(?:permission|consent)", "without"),
    ("proprietary", "for internal use only", "internal"),
    ("proprietary", "this software contains trade secrets", "secrets"),
    ("eula", "end user licen[sc]e agreement", "agreement"),
    ("eula", "by (?:installing|downloading|using) (?:this|the) software you agree to be bound by (?:the terms of )?this (?:agreement|licen[sc]e)", "bound"),
    ("freeware", "this software is (?:freeware|free for (?:personal|non ?commercial|private) use)", "software"),
    ("non-commercial", "for (?:non ?commercial|personal and non ?commercial) use only", "use"),
    ("non-commercial", "for (?:research|academic|educational)(?: and (?:research|academic|educational))? (?:use|purposes) only", "only"),
    ("non-commercial", "not for commercial use", "commercial"),
    ("evaluation", "for evaluation purposes only", "evaluation"),
    ("dual", "(?:dual|double|multi) licensed under", "licensed"),
    ("dual", "at your option under the terms of either", "option"),
    ("see-license", "see (?:the )?(?:accompanying |included |enclosed )?(?:file )?(?:licen[sc]e|copying)(?: txt| md)?(?: file)? for (?:more |full |the )?(?:licen[sc]e )?(?:details|information|terms)", "see"),
)
