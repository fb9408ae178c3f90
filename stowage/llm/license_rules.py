"""The signature rules of the license scan: plain text, in order of priority groups.

A rule is a line `label | priority | strength | keywords | pattern`.  Patterns are written over normalised text: words of
letters and digits, lower case, one space between any two, so `Apache License, Version 2.0` reads
`apache license version 2 0`.  A pattern starts and ends at whole words.  `#` in it stands for a space and an optional word
for version; `<v>` in label, keywords and pattern makes one rule for each version in braces at the end of the line, divided
by blanks, or by semicolons where a version has two words.
Keywords: every match of the pattern holds one of them as a whole word, so a text without them is not searched.
Priority: 9 full grants and identifiers, 7 named licenses with a version or a telling sentence, 5 named licenses, 3 families
and terms, 1 notices.  Strength: how sure a match makes that the text states its license.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    strength: float
    keywords: frozenset[str]
    pattern: re.Pattern[bytes]
    base: bool


#: Phrases whose places are always reported, whatever other rule holds them.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

RULES = r"""
# The GNU family: identifiers, grants, names with and without versions
gpl-<v>-or-later | 9 | .98 | spdx | spdx license identifier gpl <v>(?: 0)?(?: or later)  {1 2 3}
gpl-<v>-only | 9 | .98 | spdx | spdx license identifier gpl <v>(?: 0)?(?: only)?  {1 2 3}
lgpl-<v>-or-later | 9 | .98 | spdx | spdx license identifier lgpl <v> or later  {2 0;2 1;3 0}
lgpl-<v>-only | 9 | .98 | spdx | spdx license identifier lgpl <v>(?: only)?  {2 0;2 1;3 0}
agpl-<v>-or-later | 9 | .98 | spdx | spdx license identifier agpl <v> 0 or later  {1 3}
agpl-<v>-only | 9 | .98 | spdx | spdx license identifier agpl <v> 0(?: only)?  {1 3}
gfdl-<v> | 9 | .98 | spdx | spdx license identifier gfdl <v>(?: only| or later)?  {1 1;1 2;1 3}
gpl-<v>-or-later | 9 | .97 | redistribute | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <v>(?: 0)? of the license or(?: at your option)? any later version  {1 2 3}
gpl-<v>-only | 9 | .97 | redistribute | redistribute it and or modify it under the terms of the gnu general public license version <v>(?: 0)?(?: only)? as published by the free software foundation  {1 2 3}
lgpl-<v>-or-later | 9 | .97 | redistribute | redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation either version <v> of the license or(?: at your option)? any later version  {2;2 1;3}
agpl-<v>-or-later | 9 | .97 | redistribute | redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version <v> of the license or(?: at your option)? any later version  {1 3}
gpl-<v> | 7 | .9 | licensed licenced released distributed | (?:licensed|licenced|released|distributed) under(?: the)?(?: terms of(?: the)?)?(?: gnu)? (?:gpl|general public license)#<v>(?: 0)?  {1 2 3}
gpl-<v>-or-later | 7 | .9 | gpl general | (?:gnu )?(?:gpl|general public license)#<v>(?: 0)? or(?: at your option)?(?: any)? later(?: version)?  {1 2 3}
gpl-<v> | 7 | .85 | general | (?:gnu )?general public license#<v>(?: 0)?  {1 2 3}
gpl-<v> | 7 | .8 | gpl gplv<v> | (?:gnu )?(?:gpl#<v>|gplv<v>)(?: 0)?  {1 2 3}
lgpl-<v>-or-later | 7 | .9 | lgpl lesser library | (?:gnu )?(?:lgpl|(?:lesser|library) general public license)#<v> or(?: at your option)?(?: any)? later(?: version)?  {2;2 0;2 1;3;3 0}
lgpl-<v> | 7 | .9 | lesser library | (?:gnu )?(?:lesser|library) general public license#<v>  {2;2 0;2 1;3;3 0}
lgpl-<v> | 7 | .85 | lgpl lgplv2 lgplv3 | (?:gnu )?(?:lgpl#<v>|lgplv<v>)  {2;2 0;2 1;3;3 0}
agpl-<v> | 7 | .9 | affero | (?:gnu )?affero general public license#<v>(?: 0)?  {1 3}
agpl-<v> | 7 | .85 | agpl agplv3 agplv1 | (?:gnu )?(?:agpl#<v>|agplv<v>)(?: 0)?  {1 3}
gfdl-<v> | 7 | .9 | free | (?:gnu )?free documentation license version <v>(?: or any later version)?  {1 1;1 2;1 3}
agpl | 5 | .8 | affero | (?:gnu )?affero (?:general public license|gpl)
lgpl | 5 | .8 | lesser library | (?:gnu )?(?:lesser|library) (?:general public license|gpl)
gfdl | 5 | .8 | free | gnu free documentation license
gpl | 5 | .8 | gnu | gnu general public licen[cs]e
gpl | 5 | .7 | gnu | gnu gpl
gpl | 3 | .6 | gpl gpld | (?:under|the)(?: terms of)?(?: the)? gpl(?:d)?(?: license)?
gpl-linking-exception | 5 | .7 | linking | (?:gpl|general public license)(?: [^ ]+){1,2} linking exception
gpl-classpath-exception | 5 | .8 | classpath | (?:with )?(?:the )?classpath exception
gpl-autoconf-exception | 5 | .7 | autoconf | (?:with )?(?:the )?autoconf exception
gpl-font-exception | 5 | .7 | font | (?:gpl|general public license) with font exception
free-software-foundation | 3 | .4 | free | published by the free software foundation
free-software | 1 | .3 | free | this (?:program|library|package) is free software

# Apache
apache-<v> | 9 | .98 | spdx | spdx license identifier apache <v>  {1 0;1 1;2 0}
apache-2.0 | 9 | .98 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-<v> | 7 | .9 | apache | (?:the )?apache(?: software)? licen[cs]e#<v>  {1 0;1 1;2 0}
apache-2.0 | 7 | .85 | apache | (?:the )?apache(?: software)?(?: public)? licen[cs]e#2
apache-2.0 | 7 | .85 | apache | (?:licensed|released) under(?: the)?(?: terms of the)? apache#2(?: 0)?
apache-2.0 | 7 | .8 | apache asl | (?:apache|asl)#2 0
apache-2.0 | 7 | .8 | apache | www apache org licenses license 2 0
apache | 5 | .7 | apache | (?:the )?apache(?: software)? licen[cs]e
apache-nodes | 3 | .5 | asf | licensed to the apache software foundation asf
llvm-exception | 7 | .8 | llvm | (?:apache license v2 0 |apache 2 0 )?with llvm exceptions?

# MIT and its relatives
mit | 9 | .98 | spdx | spdx license identifier mit
mit-0 | 9 | .98 | spdx | spdx license identifier mit 0
mit | 9 | .97 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | 7 | .85 | mit | mit(?: license)? (?:no attribution|zero)
mit | 7 | .9 | mit | (?:licensed|licenced|released|available|distributed|published) under(?: the)?(?: terms of(?: the)?)? mit(?: license)?
mit | 7 | .85 | mit | (?:the )?mit (?:x11 )?licen[cs]e
mit | 7 | .8 | mit | www opensource org licenses mit(?: license)?(?: php)?
mit | 5 | .7 | mit | licen[cs]e (?:is )?mit
expat | 5 | .8 | expat | (?:the )?expat licen[cs]e
x11 | 7 | .8 | x11 | (?:the )?(?:mit )?x11 (?:style )?licen[cs]e
isc | 9 | .98 | spdx | spdx license identifier isc
isc | 9 | .97 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 7 | .85 | isc | (?:the )?isc licen[cs]e
hpnd | 7 | .8 | permission | permission to use copy modify and distribute this software and its documentation for any purpose
hpnd | 7 | .8 | hpnd | historical permission notice and disclaimer(?: hpnd)|hpnd licen[cs]e
ntp | 7 | .8 | ntp | (?:the )?ntp licen[cs]e
curl | 7 | .8 | curl | (?:the )?curl licen[cs]e
fair | 7 | .7 | fair | (?:the )?fair licen[cs]e
boost-1.0 | 9 | .98 | spdx | spdx license identifier bsl 1 0
boost-1.0 | 7 | .9 | boost | (?:distributed under the )?boost software licen[cs]e(?: version 1 0)?
warranty-disclaimer-mit | 3 | .6 | warranty | the software is provided as is without warranty of any kind

# BSD
bsd-<v>-clause | 9 | .98 | spdx | spdx license identifier bsd <v> clause  {1 2 3 4}
0bsd | 9 | .98 | spdx | spdx license identifier 0bsd
bsd-3-clause | 9 | .95 | endorse | neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software
bsd-4-clause | 9 | .95 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | 7 | .8 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-<v>-clause | 7 | .9 | bsd | bsd <v> clause(?: licen[cs]e)?  {1 2 3 4}
bsd-<v>-clause | 7 | .9 | clause | <v> clause bsd(?: licen[cs]e)?  {1 2 3 4}
bsd-2-clause | 7 | .85 | simplified | simplified bsd(?: licen[cs]e)?
bsd-2-clause | 7 | .85 | freebsd | freebsd licen[cs]e
bsd-3-clause | 7 | .85 | bsd | (?:new|revised|modified) bsd(?: licen[cs]e)?
bsd-4-clause | 7 | .85 | bsd | (?:original|old) bsd(?: licen[cs]e)?
0bsd | 7 | .85 | 0bsd zero | (?:0bsd|zero clause bsd)(?: licen[cs]e)?
bsd | 5 | .7 | bsd | (?:the )?bsd (?:style |type )?licen[cs]e
bsd | 5 | .7 | bsd | (?:licensed|released|distributed) under(?: the)? bsd
bsd-disclaimer | 3 | .5 | merchantability | implied warranties of merchantability and fitness for a particular purpose are disclaimed

# Creative Commons
cc0-1.0 | 9 | .98 | spdx | spdx license identifier cc0 1 0
cc-by-<v> | 9 | .98 | spdx | spdx license identifier cc by <v>  {1 0;2 0;2 5;3 0;4 0}
cc-by-sa-<v> | 9 | .98 | spdx | spdx license identifier cc by sa <v>  {1 0;2 0;2 5;3 0;4 0}
cc-by-nc-<v> | 7 | .9 | cc | cc by nc <v>  {1 0;2 0;2 5;3 0;4 0}
cc-by-nd-<v> | 7 | .9 | cc | cc by nd <v>  {1 0;2 0;2 5;3 0;4 0}
cc-by-sa-<v> | 7 | .9 | cc | cc by sa <v>  {1 0;2 0;2 5;3 0;4 0}
cc-by-nc-sa-<v> | 7 | .9 | cc | cc by nc sa <v>  {1 0;2 0;2 5;3 0;4 0}
cc-by-nc-nd-<v> | 7 | .9 | cc | cc by nc nd <v>  {1 0;2 0;2 5;3 0;4 0}
cc-by-<v> | 7 | .9 | cc | cc by <v>  {1 0;2 0;2 5;3 0;4 0}
cc-by-nc | 5 | .8 | cc | cc by nc
cc-by-nd | 5 | .8 | cc | cc by nd
cc-by-sa | 5 | .8 | cc | cc by sa
cc-by-nc-sa | 5 | .8 | cc | cc by nc sa
cc-by-nc-nd | 5 | .8 | cc | cc by nc nd
cc-by-nc-sa | 7 | .9 | commons | creative commons attribution non ?commercial share ?alike(?: (?:licen[cs]e )?(?:version )?[1-4](?: [05])?)?
cc-by-nc-nd | 7 | .9 | commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: (?:licen[cs]e )?(?:version )?[1-4](?: [05])?)?
cc-by-nc | 7 | .85 | commons | creative commons attribution non ?commercial
cc-by-nd | 7 | .85 | commons | creative commons attribution no ?deriv(?:ative)?s?
cc-by-sa | 7 | .85 | commons | creative commons attribution share ?alike
cc-by-<v> | 7 | .9 | commons | creative commons attribution <v>(?: (?:international|unported|generic))?(?: (?:public )?licen[cs]e)?  {1 0;2 0;2 5;3 0;4 0}
cc-by | 5 | .8 | commons | creative commons attribution(?: licen[cs]e)?
cc0-1.0 | 7 | .9 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 7 | .85 | commons | creative commons zero
cc-by-<v> | 7 | .9 | creativecommons | creativecommons org licenses by <v>  {1 0;2 0;2 5;3 0;4 0}
cc-by-sa-<v> | 7 | .9 | creativecommons | creativecommons org licenses by sa <v>  {1 0;2 0;2 5;3 0;4 0}
cc-by-nc-<v> | 7 | .9 | creativecommons | creativecommons org licenses by nc <v>  {1 0;2 0;2 5;3 0;4 0}
cc0-1.0 | 7 | .9 | creativecommons | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | 7 | .85 | creativecommons | creativecommons org publicdomain mark 1 0
creative-commons | 3 | .6 | commons | creative commons licen[cs]es?

# Mozilla, Eclipse, Sun and other named licenses with versions
mpl-<v> | 9 | .98 | spdx | spdx license identifier mpl <v>  {1 0;1 1;2 0}
mpl-2.0 | 9 | .97 | mozilla | subject to the terms of the mozilla public license v 2 0
mpl-<v> | 7 | .9 | mozilla | mozilla public licen[cs]e#<v>  {1 0;1 1;2 0}
mpl-<v> | 7 | .85 | mpl | mpl#<v>  {1 0;1 1;2 0}
mpl | 5 | .7 | mozilla | mozilla public licen[cs]e
npl-<v> | 7 | .8 | netscape | netscape public licen[cs]e(?: version)? <v>  {1 0;1 1}
epl-<v> | 9 | .98 | spdx | spdx license identifier epl <v>  {1 0;2 0}
epl-<v> | 7 | .9 | eclipse | eclipse public licen[cs]e#<v>  {1 0;2 0}
epl-<v> | 7 | .85 | epl | epl#<v>  {1 0;2 0}
edl-1.0 | 7 | .8 | eclipse | eclipse distribution licen[cs]e(?: v| version)?(?: 1 0)?
epl | 5 | .7 | eclipse | eclipse public licen[cs]e
cpl-1.0 | 7 | .8 | common | common public licen[cs]e(?: version)?(?: 1 0)?
ipl-1.0 | 7 | .8 | ibm | ibm public licen[cs]e(?: version)?(?: 1 0)?
cddl-<v> | 9 | .98 | spdx | spdx license identifier cddl <v>  {1 0;1 1}
cddl-<v> | 7 | .9 | distribution | common development and distribution licen[cs]e(?: cddl)?#<v>  {1 0;1 1}
cddl | 5 | .7 | distribution | common development and distribution licen[cs]e
cddl | 5 | .7 | cddl | (?:the )?cddl(?: licen[cs]e)?
eupl-<v> | 7 | .9 | eupl european | (?:european union public licen[cs]e|eupl)#<v>  {1 0;1 1;1 2}
eupl | 5 | .7 | european | european union public licen[cs]e
cecill-<v> | 7 | .85 | cecill | cecill(?: licen[cs]e)?#<v>  {1 0;1 1;2 0;2 1}
cecill | 5 | .7 | cecill | cecill(?: [bc])?(?: licen[cs]e)?
afl-<v> | 7 | .85 | academic | academic free licen[cs]e#<v>  {1 1;1 2;2 0;2 1;3 0}
afl | 5 | .7 | academic | academic free licen[cs]e
osl-<v> | 7 | .85 | open | open software licen[cs]e#<v>  {1 0;1 1;2 0;2 1;3 0}
artistic-<v> | 7 | .85 | artistic | artistic licen[cs]e#<v>  {1 0;2 0}
artistic | 5 | .7 | artistic | (?:the )?artistic licen[cs]e
perl | 5 | .7 | perl | same terms as perl(?: itself)?
python-2.0 | 7 | .85 | python | python(?: software foundation)? licen[cs]e(?: version)? 2(?: 0)?
psf | 5 | .8 | psf python | (?:psf licen[cs]e|python software foundation licen[cs]e)
php-<v> | 7 | .85 | php | php licen[cs]e#<v>  {2 02;3 0;3 01}
php | 5 | .7 | php | (?:the )?php licen[cs]e
ruby | 5 | .7 | ruby | (?:same|under the) (?:terms as ruby(?: itself)?|ruby licen[cs]e)
zlib | 9 | .98 | spdx | spdx license identifier zlib
zlib | 9 | .95 | misrepresented | the origin of this software must not be misrepresented
zlib | 7 | .8 | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
libpng | 7 | .8 | libpng | (?:the )?libpng licen[cs]e
openssl | 7 | .8 | openssl | (?:the )?openssl(?: ssleay)? licen[cs]e
openssl | 7 | .8 | openssl | (?:for use in|developed by) the openssl (?:toolkit|project)
unlicense | 9 | .97 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 7 | .85 | unlicense | (?:the )?unlicense(?: license)?
wtfpl | 7 | .9 | wtfpl | wtfpl
wtfpl | 7 | .9 | fuck | do what the fuck you want to public licen[cs]e
beerware | 7 | .8 | beer beerware | beer ?ware licen[cs]e
jquery | 5 | .5 | jquery | jquery (?:foundation )?licen[cs]e
json | 7 | .85 | evil | the software shall be used for good not evil
vim | 5 | .7 | vim | (?:the )?vim licen[cs]e
tcl | 5 | .7 | tcl | (?:the )?tcl(?: tk)? licen[cs]e
icu | 5 | .7 | icu unicode | (?:icu|unicode) licen[cs]e
unicode-dfs | 7 | .8 | unicode | unicode(?: inc)? license agreement(?: data files and software)?
w3c | 7 | .8 | w3c | w3c(?: r)? software(?: and document)?(?: notice and)? licen[cs]e
ms-pl | 7 | .85 | microsoft | microsoft public licen[cs]e(?: ms pl)?
ms-rl | 7 | .85 | microsoft | microsoft reciprocal licen[cs]e(?: ms rl)?
apsl-2.0 | 7 | .8 | apple | apple public source licen[cs]e(?: version)?(?: 2 0)?
sleepycat | 7 | .8 | sleepycat | sleepycat (?:public )?licen[cs]e
postgresql | 7 | .8 | postgresql | (?:the )?postgresql licen[cs]e
ncsa | 7 | .85 | ncsa | (?:university of illinois )?(?:ncsa open source|uiuc ncsa) licen[cs]e
qpl-1.0 | 7 | .8 | q | (?:the )?q public licen[cs]e(?: version 1 0)?
ofl-<v> | 7 | .9 | font ofl | (?:sil )?(?:open font licen[cs]e|ofl)#<v>  {1 0;1 1}
ofl | 5 | .8 | font ofl | (?:sil )?open font licen[cs]e|sil ofl
bitstream-vera | 7 | .7 | bitstream | bitstream vera(?: fonts?)? (?:copyright|licen[cs]e)
lppl-<v> | 7 | .85 | latex lppl | (?:latex project public licen[cs]e|lppl)#<v>  {1 0;1 1;1 2;1 3}
odbl-1.0 | 7 | .85 | database odbl | open (?:data commons open )?database licen[cs]e(?: odbl)?(?: v?1 0)?|odbl(?: 1 0)?
odc-by | 7 | .85 | commons odc | open data commons attribution licen[cs]e|odc by(?: 1 0)?
pddl | 7 | .85 | pddl commons | open data commons public domain dedication(?: and licen[cs]e)?|pddl(?: 1 0)?
ogl-uk-<v> | 7 | .85 | government | open government licen[cs]e#<v>(?: 0)?  {1 2 3}
etalab-2.0 | 7 | .8 | etalab ouverte | (?:etalab|licence ouverte)(?: open licen[cs]e)?(?:#2 0)?

# Source-available, commercial and content terms
busl-1.1 | 7 | .9 | business busl | business source licen[cs]e(?: version)?(?: 1 1)?|busl 1 1
sspl-1.0 | 7 | .9 | server sspl | server side public licen[cs]e(?:#1)?|sspl(?: v?1(?: 0)?)?
elastic-2.0 | 7 | .85 | elastic | elastic licen[cs]e(?: v?2(?: 0)?)?
commons-clause | 7 | .85 | commons | commons clause(?: licen[cs]e)?(?: condition)?
polyform | 7 | .85 | polyform | polyform (?:noncommercial|small business|strict|shield|perimeter|free trial)(?: licen[cs]e)?
llama-community | 7 | .8 | llama | llama(?: [23])?(?: [0-9])? community licen[cs]e
openrail | 7 | .8 | openrail openrailm rail railm | (?:bigscience |creativeml )?(?:open ?rail ?m?)(?: licen[cs]e)?
proprietary | 5 | .7 | proprietary | (?:this (?:software|code|file|document) is )?proprietary(?: and confidential)(?: information)?
proprietary | 5 | .7 | proprietary | proprietary licen[cs]e
proprietary | 5 | .7 | unauthorised unauthorized | unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or distribution)? of this (?:file|software|document|work)
commercial | 5 | .6 | commercial | (?:under a|requires a|valid) commercial licen[cs]e
non-commercial | 5 | .6 | commercial noncommercial | for non ?commercial use only|for (?:personal|private|educational)(?: and)? non ?commercial (?:use|purposes)
no-derivatives | 5 | .5 | derivative | no derivative works
eula | 5 | .6 | eula user | end user licen[cs]e agreement|eula
terms-of-use | 3 | .4 | terms | (?:by using|subject to) (?:this|these|the|our) (?:[^ ]+ ){0,3}terms of (?:use|service)
confidential | 3 | .4 | confidential | (?:strictly|company|highly) confidential
trade-secret | 3 | .5 | trade | (?:contains|valuable) trade secrets?
permission-required | 3 | .5 | permission | without(?: the)?(?: prior)?(?: express)?(?: written)? permission of(?: the)? (?:publisher|author|copyright|owner)s?
no-reproduction | 3 | .6 | reproduced | no part of this (?:publication|book|work|document) may be reproduced

# Public domain and dual licensing
public-domain | 7 | .8 | domain | (?:released|placed|dedicated|donated|put) (?:into|in|to) the public domain
public-domain | 5 | .6 | domain | (?:this (?:work|file|software|text|book) )?is in the public domain
public-domain | 5 | .6 | gemeinfrei | (?:dieses werk ist )?gemeinfrei
public-domain | 5 | .6 | domaine | (?:dans le|du) domaine public
public-domain | 5 | .6 | dominio | (?:en el|de) dominio publico
dual-license | 3 | .6 | dual dually | (?:dual|dually) licen[cs]ed(?: under)?
multi-license | 3 | .6 | either | under either (?:the )?[^ ]+ (?:license )?or (?:the )?[^ ]+
see-license-file | 3 | .5 | see | see(?: the)?(?: file)? (?:license|licence|copying|copyright)(?: md| txt)?(?: file)? (?:for|in)(?: more)?(?: the)? (?:details|root|information|terms)
spdx-other | 5 | .8 | spdx | spdx license identifier [^ ]+

# Notices
copyright | 1 | .4 | copyright | copyright(?: c)? (?:19|20)[0-9][0-9]
copyright | 1 | .35 | copyright | copyright(?: c)? by
copyright | 1 | .35 | c | c (?:19|20)[0-9][0-9](?: by)?
copyright-holders | 1 | .35 | copyright | (?:and )?the copyright holders?
some-rights-reserved | 3 | .6 | rights | some rights reserved
no-rights-reserved | 3 | .6 | rights | no rights reserved
reserved-de | 3 | .6 | rechte | alle rechte vorbehalten
reserved-fr | 3 | .6 | droits | tous droits reserves|tous droits réservés
reserved-es | 3 | .6 | derechos | todos los derechos reservados
permission-notice | 3 | .5 | notice | the above copyright notice and this permission notice shall be included
as-is | 1 | .3 | as | (?:is )?provided as is
"""


def _spelled(line: str):
    """The rules of one line, one for each version."""
    label, priority, strength, keywords, pattern = (x.strip() for x in line.split(" | ", 4))
    versions = [""]
    if m := re.search(r"\s\{([^{}]*)\}$", pattern):
        versions = [v.strip() for v in (m[1].split(";") if ";" in m[1] else m[1].split())]
        pattern = pattern[: m.start()].strip()
    pattern = pattern.replace("#", " (?:v ?|ver |version )?")
    for v in versions:
        named = label.replace("<v>", v.replace(" ", "."))
        yield Rule(named, int(priority), float(strength), frozenset(keywords.replace("<v>", v).split()), _compiled(pattern.replace("<v>", v)), False)


def _compiled(pattern: str) -> re.Pattern[bytes]:
    return re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])")


def rules(text: str = RULES) -> list[Rule]:
    """All rules: the base phrases, which nothing suppresses, and then those of text from the highest priority down,
    within one priority in the order of the text."""
    base = [Rule(label, 10, 0.6, frozenset({phrase.split()[0]}), _compiled(phrase), True) for phrase, label in BASE.items()]
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return base + sorted((r for x in lines for r in _spelled(x)), key=lambda r: -r.priority)
