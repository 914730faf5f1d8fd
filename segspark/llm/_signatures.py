"""Hand-written license signatures: clauses, titles, notices and links.

Each has a label, gate keywords (cut at |, one of which is part of all that the pattern
matches), a pattern over lower-case words joined by single blanks, and a strength.
"""

from __future__ import annotations

#: Wordings of public licenses.
SIGNATURES = [
    # permissive grants
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "without restriction including", r"to deal in the software without restriction including without limitation the rights", 0.9),
    ("mit", "sell copies", r"use copy modify merge publish distribute sublicense and or sell copies of the software", 0.9),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software", 0.9),
    ("mit-0", "mit no attribution", r"mit no attribution(?: license)?", 0.9),
    ("mit-advertising", "except as contained in this notice", r"except as contained in this notice the names? of (?:\S+ ){1,12}shall not be used in advertising", 0.8),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose", 0.95),
    ("isc", "with or without fee is hereby granted", r"for any purpose with or without fee is hereby granted provided that", 0.9),
    ("isc", "the software is provided as is and the author", r"the software is provided as is and the author disclaims all warranties", 0.8),
    ("hpnd", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation", 0.85),
    ("hpnd", "that the name of", r"that the name of (?:\S+ ){1,8}not be used in advertising or publicity", 0.8),
    ("0bsd", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 0.95),
    ("x11", "x consortium", r"(?:of the )?x consortium shall not be used in advertising", 0.9),
    ("xfree86", "xfree86", r"xfree86 project(?: inc)?", 0.7),
    ("ntp", "makes no representations about the suitability", r"makes no representations about the suitability(?: of)? this software for any purpose", 0.7),
    ("beerware", "beer", r"(?:can )?buy me a beer in return", 0.9),
    ("beerware", "beerware", r"the beerware license", 0.9),
    ("wtfpl", "do what the", r"do what the (?:fuck|f) you want to(?: public license)?", 0.95),
    ("wtfpl", "you just do", r"you just do what the (?:fuck|f) you want to", 0.95),
    ("postgresql", "without fee and without a written agreement", r"without fee and without a written agreement is hereby granted", 0.9),
    ("postgresql", "provide maintenance support", r"has no obligations? to provide maintenance support updates enhancements or modifications", 0.8),
    ("curl", "copyright and permission notice", r"copyright and permission notice(?: copyright)? (?:c )?(?:\d{4} )?(?:\d{4} )?daniel stenberg", 0.9),
    ("ncsa", "with the software without restriction", r"to deal with the software without restriction", 0.85),
    ("ncsa", "documentation files the software to deal with", r"and associated documentation files the software to deal with the software", 0.85),
    ("unicode", "unicode data files", r"unicode data files and any associated documentation", 0.9),
    ("unicode", "unicode inc license agreement", r"unicode inc license agreement", 0.9),
    ("bsl-1", "boost org", r"(?:www )?boost org license 1 0", 0.9),
    ("bsl-1", "machine executable object code", r"solely in the form of machine executable object code generated by a source language processor", 0.95),
    ("bsl-1", "obtaining a copy of the software and accompanying", r"obtaining a copy of the software and accompanying documentation covered by this license", 0.9),
    ("zlib", "as is without", r"this software is provided as is without any express or implied warranty in no event will the authors", 0.8),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented", 0.95),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 0.95),
    ("libpng", "contributing authors", r"the contributing authors and group 42", 0.8),
    ("libpng", "png reference library", r"the png reference library is supplied as is", 0.9),
    ("ijg", "independent jpeg group", r"(?:the )?independent jpeg group s software", 0.8),
    ("freetype", "freetype project", r"portions of this software are copyright (?:\S+ ){0,4}the freetype project", 0.9),
    ("freetype", "freetype project license", r"the freetype project license", 0.9),
    ("icu", "international business machines", r"international business machines corporation and others all rights reserved", 0.6),
    ("w3c", "w3c", r"w3c software (?:notice and )?(?:and document )?license", 0.9),
    ("w3c", "work is being provided by the copyright holders", r"this work is being provided by the copyright holders under the following license", 0.85),
    ("naist", "nara institute", r"nara institute of science and technology(?: naist)?", 0.6),
    ("fsf-all-permissive", "copying and distribution of this file", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 0.95),
    ("fsf-unlimited", "gives unlimited permission", r"(?:the )?free software foundation gives unlimited permission to copy and or distribute it", 0.9),
    ("blessing", "may you do good", r"may you do good and not evil", 0.9),
    ("blessing", "may you share freely", r"may you share freely never taking more than you give", 0.9),
    ("json", "be used for good", r"the software shall be used for good not evil", 0.95),
    # bsd family
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification", 0.9),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd", "regents of the university", r"(?:the )?regents of the university of california", 0.7),
    ("bsd-3", "neither the name", r"neither the names? of (?:\S+ ){1,8}nor the names of (?:its|their|any) contributors", 0.9),
    ("bsd-3", "endorse or promote products", r"(?:may|must not) be used to endorse or promote products derived from this software", 0.85),
    ("bsd-4", "all advertising materials", r"all advertising materials mentioning features or use of this software must display", 0.95),
    ("bsd-4", "this product includes software developed by", r"this product includes software developed by the university of california", 0.9),
    ("bsd-2", "views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors", 0.9),
    ("bsd-patent", "subject to the terms and conditions of this license each copyright holder", r"subject to the terms and conditions of this license each copyright holder and contributor hereby grants", 0.9),
    ("bsd-clear", "no express or implied licenses to any party s patent", r"no express or implied licenses to any party s patent rights are granted by this license", 0.95),
    ("bsd-nuclear", "nuclear facility", r"(?:design construction|designed licensed or intended for use in the design construction) operation or maintenance of any nuclear facility", 0.9),
    ("bsd-protection", "bsd protection license", r"bsd protection license", 0.9),
    # apache
    ("apache-2", "apache org licenses", r"(?:www )?apache org licenses license 2 0", 0.95),
    ("apache-2", "you may not use this file except", r"you may not use this file except in compliance with the license", 0.9),
    ("apache-2", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software", 0.9),
    ("apache-2", "perpetual worldwide", r"perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", 0.85),
    ("apache-2", "as an addendum to the notice text", r"as an addendum to the notice text from the work", 0.9),
    ("apache-2", "without warranties or conditions", r"without warranties or conditions of any kind either express or implied", 0.7),
    ("apache-1", "apache group for use", r"software developed by the apache group for use in the apache http server project", 0.95),
    ("apache-1", "products derived from this software may not be called", r"products derived from this software may not be called apache", 0.95),
    ("apache-1", "apache software foundation", r"this product includes software developed by the apache software foundation", 0.8),
    # gnu family
    ("gpl", "free software you can", r"is free software you can redistribute it and or modify it under", 0.85),
    ("gpl", "gnu org licenses", r"gnu org licenses (?:old licenses )?gpl", 0.9),
    ("gpl", "you should have received a copy", r"you should have received a copy of the gnu general public license", 0.85),
    ("gpl", "without even the implied warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose", 0.6),
    ("gpl", "freedom to share and change", r"(?:intended to guarantee|to take away) your freedom to share and change", 0.9),
    ("gpl", "absolutely no warranty", r"comes with absolutely no warranty", 0.5),
    ("gpl-2", "gpl 2 0", r"gnu org licenses (?:old licenses )?gpl 2 0", 0.9),
    ("gpl-2", "june 1991", r"(?:general public license )?version 2 june 1991", 0.9),
    ("gpl-2", "copy and distribute verbatim copies of the program", r"you may copy and distribute verbatim copies of the program s source code", 0.9),
    ("gpl-2", "either version 2", r"either version 2 of the license or at your option any later version", 0.9),
    ("gpl-3", "gpl 3 0", r"gnu org licenses gpl 3 0", 0.9),
    ("gpl-3", "29 june 2007", r"general public license version 3 29 june 2007", 0.95),
    ("gpl-3", "either version 3", r"either version 3 of the license or at your option any later version", 0.9),
    ("gpl-3", "to propagate a work means", r"to propagate a work means to do anything with it", 0.95),
    ("gpl-3", "anti circumvention", r"protecting users legal rights from anti circumvention law", 0.95),
    ("gpl-3", "corresponding source for a work", r"the corresponding source for a work in object code form means", 0.9),
    ("gpl-1", "february 1989", r"general public license version 1 february 1989", 0.95),
    ("gpl-classpath", "classpath exception", r"(?:with )?(?:the )?classpath exception", 0.85),
    ("gpl-classpath", "linking this library statically", r"linking this library statically or dynamically with other modules", 0.9),
    ("gpl-gcc", "gcc runtime library exception", r"gcc runtime library exception", 0.9),
    ("gpl-bison", "bison", r"special exception you may create a larger work that contains part or all of the bison parser skeleton", 0.9),
    ("gpl-autoconf", "script generated by autoconf", r"configuration script generated by autoconf|configure script generated by autoconf", 0.8),
    ("gpl-font", "as a special exception if you create a document", r"as a special exception if you create a document which uses this font", 0.9),
    ("lgpl", "gnu org licenses lgpl", r"gnu org licenses lgpl", 0.9),
    ("lgpl", "you should have received a copy of the gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license", 0.9),
    ("lgpl-2", "february 1999", r"lesser general public license version 2 1 february 1999", 0.95),
    ("lgpl-2", "june 1991", r"library general public license version 2 june 1991", 0.95),
    ("lgpl-2", "work that uses the library", r"(?:is called )?a work that uses the library", 0.85),
    ("lgpl-3", "incorporates the terms and conditions", r"incorporates the terms and conditions of version 3 of the gnu general public license supplemented by", 0.95),
    ("lgpl-3", "combined work", r"a combined work is a work produced by combining or linking an application with the library", 0.95),
    ("agpl-3", "gnu org licenses agpl", r"gnu org licenses agpl", 0.9),
    ("agpl-3", "november 2007", r"affero general public license version 3 19 november 2007", 0.95),
    ("agpl-3", "interacting with it remotely", r"all users interacting with it remotely through a computer network", 0.95),
    ("agpl-1", "affero general public license version 1", r"affero general public license version 1", 0.9),
    ("gfdl", "gnu org licenses fdl", r"gnu org licenses fdl", 0.9),
    ("gfdl", "invariant sections", r"with (?:no|the) invariant sections", 0.85),
    ("gfdl", "front cover texts", r"(?:no|with the) front cover texts(?: and)?", 0.7),
    ("gfdl", "permission is granted to copy distribute", r"permission is granted to copy distribute and or modify this document under the terms of the gnu", 0.95),
    # weak copyleft
    ("mpl-2", "mozilla org", r"mozilla org mpl 2 0", 0.9),
    ("mpl-2", "subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0.95),
    ("mpl-2", "incompatible with secondary licenses", r"incompatible with secondary licenses", 0.8),
    ("mpl-1", "mozilla org mpl", r"mozilla org mpl mpl 1 1", 0.9),
    ("mpl-1", "contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public license", 0.9),
    ("mpl-1", "initial developer of the original code", r"the initial developer of the original code is", 0.85),
    ("npl", "netscape public license", r"netscape public license(?: version)?(?: 1 [01])?", 0.9),
    ("epl", "accompanying program is provided under the terms", r"the accompanying program is provided under the terms of this eclipse public license", 0.95),
    ("epl", "legal epl", r"eclipse org (?:org )?(?:documents )?legal epl", 0.85),
    ("epl-1", "eclipse public license v1", r"terms of the eclipse public license v1 0", 0.9),
    ("epl-2", "eclipse public license", r"terms of the eclipse public license (?:v )?2 0|the eclipse public license 2 0", 0.9),
    ("edl-1", "eclipse distribution license", r"eclipse distribution license(?: v)?(?: 1 0)?", 0.9),
    ("cpl", "common public license", r"common public license(?: version)?(?: v)?(?: 1 0)?", 0.9),
    ("ipl", "ibm public license", r"ibm public license(?: version)?(?: 1 0)?", 0.9),
    ("cddl", "subject to the terms of the common development", r"subject to the terms of the common development and distribution license", 0.95),
    ("cddl", "opensolaris", r"(?:www )?opensolaris org os licensing", 0.85),
    ("cddl", "cddl header", r"(?:do not alter or remove copyright notices or this file header )?cddl header (?:start|end)", 0.9),
    ("ms-pl", "if you use the software you accept this license", r"if you use the software you accept this license if you do not accept the license do not use the software", 0.85),
    ("ms-rl", "reciprocal grants", r"reciprocal grants for any file you distribute", 0.9),
    ("artistic-1", "artistic", r"the artistic license preamble the intent of this document", 0.95),
    ("artistic-1", "reasonable copying fee", r"you may charge a reasonable copying fee for any distribution", 0.85),
    ("artistic-1", "same terms as perl itself", r"(?:under the )?same terms as perl itself", 0.85),
    ("artistic-2", "free software package may be copied", r"under which a given free software package may be copied modified distributed and or redistributed", 0.9),
    ("clarified-artistic", "clarified artistic", r"(?:the )?clarified artistic license", 0.9),
    ("osl-3", "licensed under the open software", r"licensed under the open software license version 3 0", 0.95),
    ("afl-3", "licensed under the academic free", r"licensed under the academic free license version 3 0", 0.95),
    ("eupl", "licensed under the eupl", r"licensed under the eupl(?: version)?(?: 1 [012])?", 0.95),
    ("eupl", "joinup ec europa", r"joinup ec europa eu (?:software page|collection) eupl", 0.9),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: v)?(?: ?[12](?: [01])?)?(?: free software)? licen[cs]e", 0.9),
    ("cecill", "governed by the cecill", r"this software is governed by the cecill(?: [bc])? license", 0.95),
    ("qpl", "q public license", r"(?:the )?q public license(?: version)?(?: 1 0)?", 0.9),
    ("sleepycat", "sleepycat", r"(?:the )?sleepycat (?:software )?license", 0.9),
    ("sleepycat", "obtain complete source code for the db", r"information on how to obtain complete source code for the db software", 0.9),
    ("php", "php software freely available", r"this product includes php software freely available from", 0.9),
    ("php", "products derived from this software may not be called php", r"products derived from this software may not be called php", 0.95),
    ("zpl", "zope public license", r"zope public license(?: zpl)?(?: version)?(?: 2 [01])?", 0.9),
    ("psf", "psf license agreement", r"psf license agreement for python", 0.95),
    ("psf", "python available to licensee", r"(?:psf|beopen|cnri) is making python available to licensee on an as is basis", 0.9),
    ("python-2", "beopen python open source", r"beopen python open source license agreement", 0.9),
    ("cnri", "cnri open source", r"cnri open source(?: gpl compatible)? license agreement", 0.9),
    ("ruby", "same terms as ruby", r"(?:under the )?same terms as ruby(?: itself)?", 0.85),
    ("ruby", "place your modifications in the public domain", r"place your modifications in the public domain or otherwise make them freely available", 0.85),
    ("vim", "charityware", r"vim is charityware you can use and copy it", 0.9),
    ("openssl", "openssl toolkit", r"(?:software developed by the openssl project )?for use in the openssl toolkit", 0.9),
    ("ssleay", "eric young", r"(?:this product includes )?cryptographic software written by eric young", 0.9),
    ("tcl", "authors hereby grant permission", r"the authors hereby grant permission to use copy modify distribute and license this software", 0.9),
    ("tcl", "government use", r"government use if you are acquiring this software on behalf of the u s government", 0.8),
    ("latex", "latex project public license", r"(?:the )?latex project public license(?: lppl)?", 0.95),
    ("latex", "lppl maintenance status", r"this work has the lppl maintenance status", 0.95),
    ("ofl-1", "licensed under the sil", r"licensed under the sil open font license", 0.95),
    ("ofl-1", "reserved font name", r"with reserved font names?", 0.9),
    ("ofl-1", "scripts sil org ofl", r"scripts sil org ofl", 0.9),
    ("bitstream-vera", "bitstream vera", r"bitstream vera is a trademark of bitstream", 0.9),
    ("ubuntu-font", "ubuntu font licen", r"ubuntu font licen[cs]e(?: version)?(?: 1 0)?", 0.9),
    ("apsl", "apple public source license", r"apple public source license(?: version)?(?: 2 0)?", 0.9),
    ("rpsl", "realnetworks public source", r"realnetworks public source license", 0.9),
    ("sissl", "sun industry standards source", r"sun industry standards source license", 0.9),
    ("spl", "sun public license", r"sun public license(?: version)?(?: 1 0)?", 0.9),
    ("nokia", "nokia open source", r"nokia open source license", 0.9),
    ("intel", "intel open source license", r"intel open source license", 0.9),
    ("nasa", "nasa open source agreement", r"nasa open source agreement(?: version)?(?: 1 3)?", 0.9),
    ("upl-1", "universal permissive license", r"the universal permissive license upl version 1 0", 0.95),
    ("mulan", "mulan", r"mulan (?:psl|permissive software license)(?: ?v?2)?", 0.9),
    ("blueoak", "blue oak model", r"blue oak model license(?: 1 0 0)?", 0.9),
    ("parity", "parity public license", r"(?:the )?parity public license", 0.9),
    ("unlicense", "released into the public", r"free and unencumbered software released into the public domain", 0.95),
    ("unlicense", "unlicense org", r"unlicense org", 0.85),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", 0.5),
    ("public-domain", "dedicated to the public", r"(?:hereby )?dedicated to the public domain", 0.7),
    ("public-domain", "no copyright", r"no copyright is claimed|this work has no copyright", 0.5),
    # creative commons and data
    ("cc-by", "creativecommons org", r"creativecommons org licenses by [1234] \d", 0.9),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1234] \d", 0.9),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [1234] \d", 0.9),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [1234] \d", 0.9),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [1234] \d", 0.95),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [1234] \d", 0.95),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero 1 0", 0.9),
    ("cc-pdm", "creativecommons org", r"creativecommons org publicdomain mark 1 0", 0.9),
    ("cc0", "copyright and related or neighboring rights", r"(?:waived|waive|waives) all copyright and related or neighboring rights", 0.9),
    ("cc-by", "you must give appropriate credit", r"you must give appropriate credit provide a link to the license", 0.8),
    ("cc-by-sa", "distribute your contributions under the same", r"you must distribute your contributions under the same license as the original", 0.85),
    ("cc-by-nc", "material for commercial purposes", r"you may not use the material for commercial purposes", 0.85),
    ("cc-by-nd", "distribute the modified material", r"you may not distribute the modified material", 0.85),
    ("cc", "some rights reserved", r"some rights reserved", 0.5),
    ("odbl", "opendatacommons org licenses odbl", r"opendatacommons org licenses odbl", 0.9),
    ("odbl", "made available under the open database", r"made available under the open database license", 0.95),
    ("odc-by", "opendatacommons org licenses by", r"opendatacommons org licenses by", 0.9),
    ("pddl", "opendatacommons org licenses pddl", r"opendatacommons org licenses pddl", 0.9),
    ("dbcl", "database contents license", r"database contents license", 0.85),
    ("ogl-uk", "open government licen", r"open government licen[cs]e(?: v(?:ersion)? ?[123](?: 0)?)?", 0.9),
    ("ogl-uk", "contains public sector information", r"contains public sector information licensed under", 0.9),
    ("etalab", "licence ouverte", r"licence ouverte(?: open licence)?", 0.9),
    ("dl-de", "datenlizenz deutschland", r"datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?", 0.9),
    ("cdla", "community data license agreement", r"community data license agreement(?: (?:permissive|sharing))?", 0.9),
    ("gutenberg", "project gutenberg", r"(?:the )?(?:full )?project gutenberg (?:tm )?license", 0.85),
    ("gutenberg", "use of anyone anywhere", r"this ebook is for the use of anyone anywhere", 0.9),
    # models, source-available, commercial
    ("openrail", "responsible ai license", r"(?:open )?responsible ai licenses?", 0.8),
    ("openrail", "use based restrictions", r"(?:the )?use based restrictions(?: as)? referenced in paragraph 5", 0.9),
    ("llama", "llama", r"llama (?:2 |3 |3 1 )?community license(?: agreement)?", 0.9),
    ("gemma", "gemma terms of use", r"gemma terms of use", 0.9),
    ("sspl", "mongodb com licensing", r"(?:www )?mongodb com licensing server side public license", 0.95),
    ("sspl", "functionality of the program", r"making the functionality of the program or modified version available to third parties", 0.9),
    ("busl", "change license", r"(?:the )?change license(?: gpl| apache| mpl)", 0.7),
    ("busl", "additional use grant", r"additional use grant", 0.8),
    ("elastic-2", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service", 0.95),
    ("commons-clause", "commons clause", r"commons clause(?: license)?(?: condition)?(?: v1 0)?", 0.9),
    ("confluent", "confluent community license", r"confluent community license(?: agreement)?", 0.9),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|internal use)(?: license)?", 0.9),
    ("prosperity", "prosperity public license", r"(?:the )?prosperity public license", 0.9),
    ("hippocratic", "hippocratic license", r"(?:the )?hippocratic license", 0.9),
    ("anti-996", "anti 996", r"anti 996 license", 0.9),
    ("non-commercial", "non commercial", r"(?:for|only for|free for) (?:research and |academic and )?non commercial (?:use|purposes)(?: only)?", 0.6),
    ("non-commercial", "noncommercial", r"(?:for|only for|free for) noncommercial (?:use|purposes)(?: only)?", 0.6),
    ("academic", "academic use only", r"(?:for )?academic use only", 0.6),
    ("evaluation", "evaluation purposes only", r"(?:for )?evaluation purposes only", 0.6),
    ("proprietary", "confidential and proprietary", r"(?:is )?(?:the )?confidential and proprietary (?:information|property)(?: of)?", 0.7),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", 0.9),
    ("proprietary", "reverse engineer", r"(?:may not|shall not|agree not to) (?:decompile |modify )?reverse engineer(?: decompile)?(?: or disassemble)?", 0.6),
    ("proprietary", "end user license agreement", r"end user license agreement", 0.6),
    ("proprietary", "licensed not sold", r"(?:the )?software is licensed not sold", 0.8),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 0.4),
    ("all-rights-reserved", "alle rechte vorbehalten", r"alle rechte vorbehalten", 0.4),
    ("all-rights-reserved", "tous droits", r"tous droits (?:de reproduction )?réservés", 0.4),
    ("all-rights-reserved", "todos los derechos reservados", r"todos los derechos reservados", 0.4),
    # links and notices
    ("mit", "opensource org", r"opensource org licenses mit", 0.9),
    ("bsd-2", "opensource org", r"opensource org licenses bsd 2 clause", 0.9),
    ("bsd-3", "opensource org", r"opensource org licenses bsd 3 clause", 0.9),
    ("isc", "opensource org", r"opensource org licenses isc", 0.9),
    ("apache-2", "opensource org", r"opensource org licenses apache 2 0", 0.9),
    ("mit", "mit license see", r"mit license see (?:the )?(?:license|copying|readme)(?: file)?", 0.85),
    ("mit", "mit style", r"(?:governed|licensed|covered) by an? mit style license", 0.8),
    ("bsd", "bsd style", r"(?:governed|licensed|covered) by an? bsd style license", 0.8),
    ("reference", "see the accompanying license", r"see the accompanying license(?: file)?", 0.4),
    ("reference", "see license in", r"see license in license", 0.4),
    ("dual-mit-gpl", "dual licensed under the mit", r"dual licensed under the mit (?:license )?and gpl(?: licenses?)?", 0.9),
    ("dual-mit-apache", "dual licensed under mit", r"dual licensed under mit (?:and|or) apache 2 0", 0.9),
    ("dual-mit-apache", "at your option", r"licensed under either of apache license version 2 0 or mit license at your option", 0.9),
]
