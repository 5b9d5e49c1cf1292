"""The signatures of the license scan. They match normalised text: lower case, words parted by one blank, no punctuation.

A license is named by (label, keywords, name): the name is a hand-written pattern, and every match of it has one of the
keywords, parted by bars, at the start of a word. Each name gives three rules: its SPDX tag, a notice that puts a work under it, and a mere mention.
TEXTS and CLAUSES are passages of license texts and notices that name no license or do not put it so, ADDRESSES where texts stand.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int
    score: float
    base: bool


_L = "licen[sc]e"
_V = "(?: version)? ?v?"
_GPL = f"(?:gnu )?(?:general public {_L}|gpl)(?: {_L})?"
_LGPL = f"(?:gnu )?(?:(?:lesser|library) general public {_L}|lgpl)(?: {_L})?"
_AGPL = f"(?:gnu )?(?:affero general public {_L}|agpl)(?: {_L})?"
_CC = f"(?:creative commons|cc)(?: {_L})?"

NAMES = [
    ("apache-1.0", "apache", f"apache(?: software)?(?: {_L})?{_V}1 0"),
    ("apache-1.1", "apache", f"apache(?: software)?(?: {_L})?{_V}1 1"),
    ("apache-2.0", "apache", f"apache(?: software)?(?: {_L})?{_V}2(?: 0)?"),
    ("mit", "mit licen|mit open source", f"mit(?: open source)? {_L}"),
    ("mit-0", "mit no attribution|mit 0", f"mit(?: no attribution| 0)(?: {_L})?"),
    ("x11", "x11", f"x11 {_L}"),
    ("expat", "expat", f"expat {_L}"),
    ("isc", "isc|internet systems", f"(?:isc|internet systems consortium) {_L}"),
    ("bsd", "bsd", f"bsd(?: style)? {_L}"),
    ("0bsd", "0bsd|zero clause|bsd", f"(?:0bsd|zero clause bsd|bsd zero clause|bsd 0 clause)(?: {_L})?"),
    ("bsd-2-clause", "bsd|simplified|freebsd", f"(?:(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause|bsd two clause)(?: simplified)?(?: {_L})?"),
    ("bsd-3-clause", "bsd", f"(?:(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause|bsd three clause)(?: new| revised)?(?: {_L})?"),
    ("bsd-4-clause", "bsd", f"(?:(?:original|old|4 clause|four clause) bsd|bsd 4 clause|bsd four clause)(?: original)?(?: {_L})?"),
    ("gpl-1.0", "general public|gnu g|gpl", f"{_GPL}{_V}1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "general public|gnu g|gpl", f"{_GPL}{_V}2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "general public|gnu g|gpl", f"{_GPL}{_V}3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.0", "lesser general|library general|lgpl", f"{_LGPL}{_V}2(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lesser general|library general|lgpl", f"{_LGPL}{_V}2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser general|library general|lgpl", f"{_LGPL}{_V}3(?: 0)?(?: only| or later)?"),
    ("agpl-3.0", "affero|agpl", f"{_AGPL}{_V}3(?: 0)?(?: only| or later)?"),
    ("gfdl-1.1", "free documentation|gfdl|fdl", f"(?:gnu )?(?:free documentation {_L}|gfdl|fdl){_V}1 1(?: or later)?"),
    ("gfdl-1.2", "free documentation|gfdl|fdl", f"(?:gnu )?(?:free documentation {_L}|gfdl|fdl){_V}1 2(?: or later)?"),
    ("gfdl-1.3", "free documentation|gfdl|fdl", f"(?:gnu )?(?:free documentation {_L}|gfdl|fdl){_V}1 3(?: or later)?"),
    ("mpl-1.0", "mozilla public|mpl", f"(?:mozilla public {_L}|mpl){_V}1 0"),
    ("mpl-1.1", "mozilla public|mpl", f"(?:mozilla public {_L}|mpl){_V}1 1"),
    ("mpl-2.0", "mozilla public|mpl", f"(?:mozilla public {_L}|mpl){_V}2(?: 0)?"),
    ("npl-1.1", "netscape", f"netscape public {_L}{_V}1(?: 0| 1)"),
    ("epl-1.0", "eclipse public|epl", f"(?:eclipse public {_L}|epl){_V}1(?: 0)?"),
    ("epl-2.0", "eclipse public|epl", f"(?:eclipse public {_L}|epl){_V}2(?: 0)?"),
    ("cpl-1.0", "common public", f"common public {_L}{_V}1(?: 0)?"),
    ("ipl-1.0", "ibm", f"ibm public {_L}{_V}1(?: 0)?"),
    ("cddl-1.0", "common development|cddl", f"(?:common development and distribution {_L}|cddl){_V}1(?: 0)?"),
    ("cddl-1.1", "common development|cddl", f"(?:common development and distribution {_L}|cddl){_V}1 1"),
    ("eupl-1.1", "european union public|eupl", f"(?:european union public {_L}|eupl){_V}1 1"),
    ("eupl-1.2", "european union public|eupl", f"(?:european union public {_L}|eupl){_V}1 2"),
    ("cecill-2.1", "cecill", f"cecill(?: b| c)?(?: {_L})?(?:{_V}2(?: 0| 1)?)?"),
    ("cc0-1.0", "cc0", f"cc0(?: {_V}1 0)?(?: universal)?"),
    ("cc-by-3.0", "creative commons|cc", f"{_CC} (?:by|attribution){_V}3 0(?: unported)?"),
    ("cc-by-4.0", "creative commons|cc", f"{_CC} (?:by|attribution){_V}4 0(?: international)?"),
    ("cc-by-sa-3.0", "creative commons|cc", f"{_CC} (?:by sa|attribution share ?alike){_V}3 0(?: unported)?"),
    ("cc-by-sa-4.0", "creative commons|cc", f"{_CC} (?:by sa|attribution share ?alike){_V}4 0(?: international)?"),
    ("cc-by-nd-4.0", "creative commons|cc", f"{_CC} (?:by nd|attribution no ?derivatives|attribution noderivs){_V}4 0(?: international)?"),
    ("cc-by-nc-3.0", "creative commons|cc", f"{_CC} (?:by nc|attribution non ?commercial){_V}3 0(?: unported)?"),
    ("cc-by-nc-4.0", "creative commons|cc", f"{_CC} (?:by nc|attribution non ?commercial){_V}4 0(?: international)?"),
    ("cc-by-nc-sa-3.0", "creative commons|cc", f"{_CC} (?:by nc sa|attribution non ?commercial share ?alike){_V}3 0(?: unported)?"),
    ("cc-by-nc-sa-4.0", "creative commons|cc", f"{_CC} (?:by nc sa|attribution non ?commercial share ?alike){_V}4 0(?: international)?"),
    ("cc-by-nc-nd-4.0", "creative commons|cc", f"{_CC} (?:by nc nd|attribution non ?commercial no ?derivatives){_V}4 0(?: international)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl|do what the", f"(?:wtfpl|do what the fuck you want to public {_L})(?:{_V}2(?: 0)?)?"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_L}"),
    ("libpng", "libpng", f"libpng(?: reference library)? {_L}"),
    ("bsl-1.0", "boost", f"boost(?: software)? {_L}(?:{_V}1(?: 0)?)?"),
    ("artistic-1.0", "artistic", f"artistic {_L}{_V}1(?: 0)?"),
    ("artistic-2.0", "artistic", f"artistic {_L}{_V}2(?: 0)?"),
    ("psf-2.0", "python|psf", f"(?:python software foundation|psf|python) {_L}(?:{_V}2(?: 0)?)?"),
    ("ruby", "ruby", f"ruby {_L}"),
    ("php-3.01", "php", f"php {_L}(?:{_V}3 0?1)?"),
    ("openssl", "openssl", f"openssl {_L}"),
    ("postgresql", "postgresql", f"postgresql {_L}"),
    ("ofl-1.1", "open font|ofl", f"(?:sil )?(?:open font {_L}|ofl){_V}1 1"),
    ("odbl-1.0", "open database|odbl", f"(?:open database {_L}|odbl)(?:{_V}1 0)?"),
    ("odc-by-1.0", "open data commons", f"open data commons attribution {_L}(?:{_V}1 0)?"),
    ("pddl-1.0", "public domain dedication|pddl", f"(?:public domain dedication and {_L}|pddl)(?:{_V}1 0)?"),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_L}"),
    ("qpl-1.0", "q public|qpl", f"(?:q public {_L}|qpl)(?:{_V}1 0)?"),
    ("sleepycat", "sleepycat", f"sleepycat {_L}"),
    ("vim", "vim", f"vim {_L}"),
    ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {_L}"),
    ("zpl-2.1", "zope|zpl", f"(?:zope public {_L}|zpl)(?:{_V}2 [01])?"),
    ("afl-3.0", "academic free|afl", f"(?:academic free {_L}|afl){_V}3(?: 0)?"),
    ("osl-3.0", "open software|osl", f"(?:open software {_L}|osl){_V}3(?: 0)?"),
    ("apsl-2.0", "apple", f"apple public source {_L}(?:{_V}2(?: 0)?)?"),
    ("ecl-2.0", "educational", f"educational community {_L}(?:{_V}2(?: 0)?)?"),
    ("lppl-1.3c", "latex project|lppl", f"(?:latex project public {_L}|lppl)(?:{_V}1 3c?)?"),
    ("ms-pl", "microsoft public|ms pl", f"(?:microsoft public {_L}|ms pl)"),
    ("ms-rl", "microsoft reciprocal|ms rl", f"(?:microsoft reciprocal {_L}|ms rl)"),
    ("nasa-1.3", "nasa", f"nasa open source agreement(?:{_V}1 3)?"),
    ("beerware", "beer", f"beer ?ware {_L}"),
    ("json", "json", f"json {_L}"),
    ("curl", "curl", f"curl {_L}"),
    ("icu", "icu", f"icu {_L}"),
    ("unicode-dfs", "unicode", f"unicode(?: terms of use| {_L} agreement| {_L})"),
    ("tcl", "tcl", f"tcl(?: tk)? {_L}"),
    ("bzip2", "bzip2", f"bzip2(?: and libbzip2)? {_L}"),
    ("ftl", "freetype", f"freetype(?: project)? {_L}"),
    ("ijg", "independent jpeg", f"independent jpeg group(?: s)? {_L}"),
    ("imlib2", "imlib2", f"imlib2 {_L}"),
    ("intel", "intel", f"intel open source {_L}"),
    ("mulanpsl-2.0", "mulan", f"mulan(?: permissive software {_L}| psl)(?:{_V}2(?: 0)?)?"),
    ("blueoak-1.0.0", "blue oak", f"blue oak model {_L}(?:{_V}1 0 0)?"),
    ("upl-1.0", "universal permissive", f"universal permissive {_L}(?:{_V}1(?: 0)?)?"),
    ("sspl-1.0", "server side public|sspl", f"(?:server side public {_L}|sspl)(?:{_V}1(?: 0)?)?"),
    ("busl-1.1", "business source", f"business source {_L}(?:{_V}1 1)?"),
    ("elastic-2.0", "elastic", f"elastic {_L}(?:{_V}2(?: 0)?)?"),
    ("commons-clause", "commons clause", f"commons clause(?: {_L})?(?: condition)?"),
    ("polyform-nc-1.0", "polyform", f"polyform non ?commercial {_L}(?:{_V}1 0 0)?"),
    ("hpnd", "historical permission", "historical permission notice and disclaimer"),
    ("eudatagrid", "eudatagrid|eu datagrid|datagrid", f"eu ?datagrid(?: software)? {_L}"),
    ("lucent-1.02", "lucent", f"lucent public {_L}(?:{_V}1 0?2)?"),
    ("naumen", "naumen", f"naumen public {_L}"),
    ("nokia", "nokia", f"nokia open source {_L}"),
    ("rpl-1.5", "reciprocal", f"reciprocal public {_L}(?:{_V}1 5)?"),
    ("simpl-2.0", "simple public", f"simple public {_L}(?:{_V}2(?: 0)?)?"),
    ("sissl", "sun industry", f"sun industry standards source {_L}"),
    ("spl-1.0", "sun public", f"sun public {_L}(?:{_V}1 0)?"),
    ("watcom-1.0", "watcom", f"sybase open watcom public {_L}(?:{_V}1 0)?"),
    ("xnet", "x net", f"x net {_L}"),
    ("openrail-m", "openrail|open rail|creativeml|bigscience|big code", f"(?:creativeml |bigscience |big code )?open ?rail(?: m)?(?: {_L})?"),
]

TEXTS = [
    ("mit", "obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "merge publish", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the software"),
    ("isc", "for any purpose with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "www apache org", f"www apache org {_L}s {_L} 2 0"),
    ("apache", "apache licen|apache software", f"apache(?: software)? {_L}"),
    ("gpl", "free software you can redistribute", "this (?:program|library|file|software) is free software you can redistribute it and or modify it"),
    ("gpl", "free software foundation", "as published by the free software foundation"),
    ("gpl", "useful but without any warranty", "in the hope that it will be useful but without any warranty"),
    ("gpl", "general public", f"(?:gnu )?general public {_L}"),
    ("gpl", "gpl", f"(?:gnu )?gpl(?: {_L})?"),
    ("lgpl", "lesser general|library general", f"(?:gnu )?(?:lesser|library) general public {_L}"),
    ("lgpl", "lgpl", f"(?:gnu )?lgpl(?: {_L})?"),
    ("agpl", "affero", f"(?:gnu )?affero general public {_L}"),
    ("mpl-2.0", "mozilla", f"subject to the terms of the mozilla public {_L}"),
    ("mpl", "mozilla public", f"mozilla public {_L}"),
    ("epl", "eclipse public", f"eclipse public {_L}"),
    ("cc", "creative commons", f"creative commons(?: [a-z]+){{0,4}} {_L}"),
    ("cc0-1.0", "waived all copyright", "has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "dedicated to the public", "dedicated to the public domain(?: under cc0)?"),
    ("unlicense", "released into the public domain", "free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:is|placed|released|are) (?:in|into) the public domain"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such"),
    ("bsl-1.0", "machine executable object code", "solely in the form of machine executable object code generated by a source language processor"),
    ("ofl-1.1", "font software", f"this font software is licensed under the sil open font {_L}"),
    ("beerware", "buy me a beer", "you can buy me a beer in return"),
    ("wtfpl", "you just do what", "you just do what the fuck you want to"),
    ("no-warranty", "without warranty of any kind", "without warranty of any kind express or implied"),
    ("no-warranty", "warranties of merchantability", "(?:implied )?warranties of merchantability(?: and)? fitness for a particular purpose"),
    ("proprietary", "proprietary and|confidential and", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "prior written", "may not be (?:copied|reproduced|distributed)(?: [a-z]+){0,6} without(?: the)?(?: express)? prior written (?:permission|consent)"),
    ("all-rights-reserved", "rights reserved", "all rights reserved"),
    ("commercial", "end user", f"end user {_L} agreement"),
    ("dual", "dual licensed", "dual licensed(?: under)?"),
]

#: Passages that tell the licenses whose text seldom names them: definitions, grants and conditions in their own words.
CLAUSES = [
    ("mit", "to deal in the software", "to deal in the software without restriction including without limitation the rights"),
    ("x11", "name of the x consortium", "the name of the x consortium shall not be used in advertising or otherwise to promote the sale"),
    ("bsd", "by the copyright holders", "this software is provided by the copyright holders and contributors as is"),
    ("bsd", "direct indirect incidental", "liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-clause", "neither the name", "neither the names? of(?: [a-z0-9]+){1,8} nor the names of (?:its|their|any) contributors may be used"),
    ("bsd-4-clause", "includes software developed by", "this product includes software developed by"),
    ("apache-1.1", "developed by the apache", "this product includes software developed by the apache software foundation"),
    ("apache-1.1", "may not be called apache", "products derived from this software may not be called apache"),
    ("apache-2.0", "contributor license agreements", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "grant of patent", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "derivative works shall mean", "derivative works shall mean any work whether in source or object form that is based on or derived from the work"),
    ("apache-2.0", "notice text file", "if the work includes a notice text file as part of its distribution"),
    ("gpl", "you should have received a copy", f"you should have received a copy of the gnu general public {_L} along with this"),
    ("gpl", "freedom not price", "when we speak of free software we are referring to freedom not price"),
    ("gpl", "verbatim copies of this license", "permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2.0", "licenses for most software", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", "activities other than copying", "activities other than copying distribution and modification are not covered by this license"),
    ("gpl-2.0", "satisfy simultaneously", "if you cannot distribute so as to satisfy simultaneously your obligations under this license"),
    ("gpl-3.0", "free copyleft", f"the gnu general public {_L} is a free copyleft {_L} for software and other kinds of works"),
    ("gpl-3.0", "to propagate a work", "to propagate a work means to do anything with it that without permission would make you"),
    ("gpl-3.0", "to convey a work", "to convey a work means any kind of propagation that enables other parties to make or receive copies"),
    ("gpl-3.0", "anti circumvention", "protecting users legal rights from anti circumvention law"),
    ("gpl-3.0", "installation information", "installation information for a user product means any methods procedures authorization keys"),
    ("lgpl", "along with this library", f"received a copy of the gnu (?:lesser|library) general public {_L} along with this library"),
    ("lgpl-2.1", "more lax criteria", "permits more lax criteria for linking other code with the library"),
    ("lgpl-2.1", "work that uses the library", "is called a work that uses the library"),
    ("lgpl-3.0", "an application is any work", "an application is any work that makes use of an interface provided by the library"),
    ("lgpl-3.0", "a combined work is", "a combined work is a work produced by combining or linking an application with the library"),
    ("agpl-3.0", "interacting with it remotely", "must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl-3.0", "network server software", "to ensure cooperation with the community in the case of network server software"),
    ("gfdl", "useful document free", "to make a manual textbook or other functional and useful document free in the sense of freedom"),
    ("gfdl", "no invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "a secondary section is", "a secondary section is a named appendix or a front matter section of the document"),
    ("mpl-1.1", "covered code means", "covered code means the original code or modifications or the combination of the original code and modifications"),
    ("mpl-2.0", "this source code form", f"this source code form is subject to the terms of the mozilla public {_L}"),
    ("mpl-2.0", "covered software means source", "covered software means source code form to which the initial contributor has attached the notice in exhibit a"),
    ("mpl-2.0", "incompatible with secondary", "incompatible with secondary licenses"),
    ("epl", "accompanying materials", f"this program and the accompanying materials are made available under the terms of the eclipse public {_L}"),
    ("cpl-1.0", "accompanying program", f"the accompanying program is provided under the terms of this common public {_L}"),
    ("ipl-1.0", "accompanying program", f"the accompanying program is provided under the terms of this ibm public {_L}"),
    ("cddl", "subject to the terms of the common", f"subject to the terms of the common development and distribution {_L}"),
    ("cddl", "covered software means a", "covered software means a the original software or b modifications"),
    ("eupl", "european union public", f"this european union public {_L} the eupl applies to the work"),
    ("cecill", "as a counterpart to the access", f"as a counterpart to the access to the source code and rights to copy modify and redistribute granted by the {_L}"),
    ("cecill", "governed by the cecill", "this software is governed by the cecill"),
    ("cc0-1.0", "affirmer hereby overtly", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("cc0-1.0", "associated a work with", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "appropriate credit", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by", "adapted material means", "adapted material means material subject to copyright and similar rights that is derived from or based upon the licensed material"),
    ("cc-by-sa", "remix transform or build", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", "remix transform or build", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-nc", "material for commercial", "you may not use the material for commercial purposes"),
    ("cc", "creative commons public", f"is provided under the terms of this creative commons public {_L} ccpl or {_L}"),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "jurisdictions that recognize", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"),
    ("wtfpl", "verbatim or modified copies", "verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("zlib", "including commercial applications", "for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", "removed or altered from any", "this notice may not be removed or altered from any source distribution"),
    ("libpng", "png reference library", "the png reference library is supplied as is"),
    ("bsl-1.0", "any person or organization", "to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("artistic-1.0", "intent of this document", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "given free software package", "the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("psf-2.0", "between the python software", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("psf-2.0", "psf is making python", "psf is making python available to licensee on an as is basis"),
    ("ruby", "make and give away verbatim", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("php-3.01", "name php", "the name php must not be used to endorse or promote products derived from this software"),
    ("php-3.01", "includes php software", "this product includes php software freely available from"),
    ("openssl", "developed by the openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "written by eric young", "this product includes cryptographic software written by eric young"),
    ("postgresql", "without a written agreement", "for any purpose without fee and without a written agreement is hereby granted"),
    ("ofl-1.1", "reserved font name refers", "reserved font name refers to any names specified as such after the copyright statement"),
    ("ofl-1.1", "neither the font software", "neither the font software nor any of its individual components in original or modified versions may be sold by itsel"),
    ("odbl-1.0", "image audiovisual material", "a work such as an image audiovisual material text or sounds resulting from using the whole"),
    ("ncsa", "to deal with the software", "to deal with the software without restriction including without limitation the rights"),
    ("sleepycat", "accompanied by information", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("vim", "unmodified copies of vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("w3c", "without fee or royalty", "with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("afl-3.0", "academic free", f"this academic free {_L} the {_L} applies to any original work of authorship"),
    ("osl-3.0", "open software", f"this open software {_L} the {_L} applies to any original work of authorship"),
    ("apsl-2.0", "original code and or modifications", f"original code and or modifications of original code as defined in and that are subject to the apple public source {_L}"),
    ("lppl", "conditions of the latex", f"distributed and or modified under the conditions of the latex project public {_L}"),
    ("lppl", "lppl maintenance", "this work has the lppl maintenance status (?:maintained|author maintained|unmaintained)"),
    ("ms-pl", "use of the accompanying software", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", "reciprocal grants", "reciprocal grants for any file you distribute that contains code from the software"),
    ("json", "used for good", "the software shall be used for good not evil"),
    ("curl", "permission to use copy modify", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("icu", "notice s and this permission", "provided that the above copyright notice s and this permission notice appear in all copies of the software"),
    ("unicode-dfs", "unicode data files", "obtaining a copy of the unicode data files and any associated documentation"),
    ("tcl", "authors hereby grant permission", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation"),
    ("ftl", "freetype project", "portions of this software are copyright(?: [a-z0-9]+){0,3} the freetype project"),
    ("ijg", "independent jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("mulanpsl-2.0", "mulan psl", "you can use this software according to the terms and conditions of the mulan psl"),
    ("upl-1.0", "subject to the condition set", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software"),
    ("blueoak-1.0.0", "each contributor licenses you", "each contributor licenses you to do everything with this software that would otherwise infringe"),
    ("sspl-1.0", "make the functionality", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "non production use", "create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "grant of rights under", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("polyform-nc-1.0", "any noncommercial purpose", "any noncommercial purpose is a permitted purpose"),
    ("hpnd", "for any purpose and without fee", "this software and its documentation for any purpose and without fee is hereby granted"),
    ("eudatagrid", "voluntary contributions made", "this software includes voluntary contributions made to the eu datagrid"),
    ("openrail-m", "derivatives of the model", "you agree not to use the model or derivatives of the model"),
    ("fair", "usage of the works", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("beerware", "retain this notice", "as long as you retain this notice you can do whatever you want with this stuf"),
    ("proprietary", "confidential and", "this software is the confidential and proprietary information o"),
    ("proprietary", "reverse engineer", "reverse engineer decompile(?: or)? disassemble"),
    ("commercial", "licensed not sold", "is licensed not sold"),
]

#: Addresses of license texts, as normalised.
ADDRESSES = [
    ("mit", "opensource org", f"opensource org {_L}s mit"),
    ("isc", "opensource org", f"opensource org {_L}s isc"),
    ("bsd-2-clause", "opensource org", f"opensource org {_L}s bsd 2 clause"),
    ("bsd-3-clause", "opensource org", f"opensource org {_L}s bsd 3 clause"),
    ("gpl-2.0", "gnu org", f"gnu org {_L}s old {_L}s gpl 2 0"),
    ("gpl-3.0", "gnu org", f"gnu org {_L}s gpl(?: 3 0)?"),
    ("lgpl-2.1", "gnu org", f"gnu org {_L}s old {_L}s lgpl 2 1"),
    ("lgpl-3.0", "gnu org", f"gnu org {_L}s lgpl(?: 3 0)?"),
    ("agpl-3.0", "gnu org", f"gnu org {_L}s agpl(?: 3 0)?"),
    ("gfdl", "gnu org", f"gnu org {_L}s fdl(?: 1 [123])?"),
    ("mpl-1.1", "mozilla org", "mozilla org mpl(?: mpl)? 1 1"),
    ("mpl-2.0", "mozilla org", "mozilla org mpl 2 0"),
    ("epl-1.0", "eclipse org", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse org", "eclipse org legal epl (?:v20|2 0)"),
    ("bsl-1.0", "boost org", f"boost org {_L} 1 0"),
    ("ofl-1.1", "scripts sil", "scripts sil org ofl"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl", "wtfpl net", "wtfpl net"),
    ("odbl-1.0", "opendatacommons", f"opendatacommons org {_L}s odbl"),
    ("pddl-1.0", "opendatacommons", f"opendatacommons org {_L}s pddl"),
    ("odc-by-1.0", "opendatacommons", f"opendatacommons org {_L}s by"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("cc-by-3.0", "creativecommons", f"creativecommons org {_L}s by 3 0"),
    ("cc-by-4.0", "creativecommons", f"creativecommons org {_L}s by 4 0"),
    ("cc-by-sa-3.0", "creativecommons", f"creativecommons org {_L}s by sa 3 0"),
    ("cc-by-sa-4.0", "creativecommons", f"creativecommons org {_L}s by sa 4 0"),
    ("cc-by-nd-4.0", "creativecommons", f"creativecommons org {_L}s by nd 4 0"),
    ("cc-by-nc-3.0", "creativecommons", f"creativecommons org {_L}s by nc 3 0"),
    ("cc-by-nc-4.0", "creativecommons", f"creativecommons org {_L}s by nc 4 0"),
    ("cc-by-nc-sa-3.0", "creativecommons", f"creativecommons org {_L}s by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", "creativecommons", f"creativecommons org {_L}s by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons", f"creativecommons org {_L}s by nc nd 4 0"),
]

_NOTICE = "(?:licensed|released|distributed|available|provided|published|covered|offered|shared|made available|redistributed)"
_UNDER = f"{_NOTICE}(?: [a-z]+){{0,2}} (?:under|by|subject to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?"

BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

_ALL = [
    *((label, phrase, phrase, 3, 0.8, True) for label, phrase in BASE),
    *((label, "spdx", f"spdx {_L} identifier {label.replace('-', ' ').replace('.', ' ')}", 3, 1.0, False) for label, _, _ in NAMES),
    *((label, keywords, f"{_UNDER} {name}", 2, 0.9, False) for label, keywords, name in NAMES),
    *((label, keywords, name, 1, 0.6, False) for label, keywords, name in NAMES),
    *((label, keywords, passage, *((1, 0.5) if len(passage) < 50 else (2, 0.8)), False) for label, keywords, passage in (*TEXTS, *CLAUSES, *ADDRESSES)),
]

#: The rules in order. Base rules are those whose detections always stay.
RULES = [Rule(label, tuple(keywords.split("|")), pattern, priority, score, base) for label, keywords, pattern, priority, score, base in _ALL]
