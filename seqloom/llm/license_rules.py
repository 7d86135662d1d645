"""Hand-written licence signatures over normalised words (lower case, one blank between words).

A line is ``label ; priority ; gate ; regex``. The gate is a literal that every match contains, so a rule
runs only on texts that hold it. Priority: 90 full grant with version, 80 named licence with version or
flavour, 70 named licence, 60 characteristic clause, 50 short tag, 30 notice, 10 hint.
"""

RULES = r"""
apache-2.0 ; 90 ; apache licen ; licensed under (?:the )?apache licen[cs]e,? version 2(?: 0)?
apache-2.0 ; 80 ; apache ; apache (?:software )?licen[cs]e (?:version |v )?v?2(?: 0)?
apache-2.0 ; 80 ; apache ; apache(?: licen[cs]e)? 2(?: 0)?
apache-2.0 ; 60 ; apache ; www apache org licenses license 2 0
apache-1.1 ; 80 ; apache ; apache (?:software )?licen[cs]e (?:version |v )?v?1 1
apache-1.0 ; 80 ; apache ; apache (?:software )?licen[cs]e (?:version |v )?v?1 0
apache ; 70 ; apache ; apache (?:software )?licen[cs]e
apache ; 50 ; asl 2 ; asl 2(?: 0)?
apache ; 50 ; alv2 ; alv2
mit ; 90 ; mit licen ; (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit ; 70 ; mit ; (?:the )?mit (?:open source )?licen[cs]e(?: mit)?
mit ; 60 ; permission is hereby granted ; permission is hereby granted free of charge to any person obtaining a copy
mit ; 60 ; software is furnished ; to permit persons to whom the software is furnished to do so
mit ; 50 ; mit ; spdx license identifier mit
mit-0 ; 80 ; mit ; mit (?:no attribution|0)(?: licen[cs]e)?
x11 ; 70 ; x11 ; x11 licen[cs]e
x11 ; 60 ; x consortium ; the x consortium shall not be used in advertising
expat ; 70 ; expat ; expat licen[cs]e
gpl-3.0-or-later ; 90 ; general public ; (?:gnu )?general public licen[cs]e,? (?:as published by the free software foundation )?(?:either )?version 3(?: 0)?(?: of the licen[cs]e)? or (?:at your option )?any later version
gpl-3.0 ; 90 ; general public ; licensed under (?:the )?(?:terms of the )?gnu general public licen[cs]e version 3(?: 0)?
gpl-3.0 ; 80 ; general public ; (?:gnu )?general public licen[cs]e (?:version |v )?v?3(?: 0)?
gpl-3.0-or-later ; 80 ; gpl ; (?:gnu )?gplv?(?: version| v)? ?3(?: 0)? or (?:any )?later
gpl-3.0 ; 70 ; gpl ; (?:gnu )?gpl ?(?:version |v )?v?3(?: 0)?(?: only)?
gpl-2.0-or-later ; 90 ; general public ; (?:gnu )?general public licen[cs]e,? (?:as published by the free software foundation )?(?:either )?version 2(?: 0)?(?: of the licen[cs]e)? or (?:at your option )?any later version
gpl-2.0 ; 90 ; general public ; licensed under (?:the )?(?:terms of the )?gnu general public licen[cs]e version 2(?: 0)?
gpl-2.0 ; 80 ; general public ; (?:gnu )?general public licen[cs]e (?:version |v )?v?2(?: 0)?
gpl-2.0-or-later ; 80 ; gpl ; (?:gnu )?gplv?(?: version| v)? ?2(?: 0)? or (?:any )?later
gpl-2.0 ; 70 ; gpl ; (?:gnu )?gpl ?(?:version |v )?v?2(?: 0)?(?: only)?
gpl-1.0 ; 80 ; general public ; (?:gnu )?general public licen[cs]e (?:version |v )?v?1(?: 0)?
gpl-1.0 ; 70 ; gpl ; (?:gnu )?gpl ?(?:version |v )?v?1(?: 0)?
gpl-any ; 70 ; gnu general public ; gnu general public licen[cs]e
gpl-any ; 50 ; gnu gpl ; gnu gpl
gpl-any ; 60 ; free software ; this program is free software you can redistribute it and or modify it
gpl-any ; 30 ; warranty of merchantability ; without even the implied warranty of merchantability or fitness for a particular purpose
gpl-any ; 30 ; general public ; you should have received a copy of the gnu general public licen[cs]e
gpl-classpath ; 80 ; classpath exception ; (?:gnu |gpl |with )?(?:the )?classpath exception
gcc-exception ; 80 ; runtime library exception ; gcc runtime library exception
lgpl-2.1 ; 90 ; lesser general public ; gnu lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v )?v?2 1
lgpl-3.0 ; 90 ; lesser general public ; gnu lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v )?v?3(?: 0)?
lgpl-2.0 ; 90 ; library general public ; gnu library general public licen[cs]e (?:version |v )?v?2(?: 0)?
lgpl-any ; 75 ; lesser general public ; (?:gnu )?lesser general public licen[cs]e
lgpl-any ; 75 ; library general public ; (?:gnu )?library general public licen[cs]e
lgpl-2.1 ; 70 ; lgpl ; (?:gnu )?lgpl ?(?:version |v )?v?2 1(?: only| or later)?
lgpl-3.0 ; 70 ; lgpl ; (?:gnu )?lgpl ?(?:version |v )?v?3(?: 0)?(?: only| or later)?
lgpl-any ; 50 ; lgpl ; (?:gnu )?lgpl
agpl-3.0 ; 90 ; affero general public ; (?:gnu )?affero general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v )?v?3(?: 0)?
agpl-1.0 ; 90 ; affero general public ; affero general public licen[cs]e (?:version |v )?v?1(?: 0)?
agpl-any ; 75 ; affero general public ; (?:gnu )?affero general public licen[cs]e
agpl-3.0 ; 70 ; agpl ; (?:gnu )?agpl ?(?:version |v )?v?3(?: 0)?(?: only| or later)?
agpl-any ; 50 ; agpl ; (?:gnu )?agpl
gfdl-1.3 ; 80 ; free documentation ; gnu free documentation licen[cs]e (?:version |v )?v?1 3
gfdl-1.2 ; 80 ; free documentation ; gnu free documentation licen[cs]e (?:version |v )?v?1 2
gfdl-1.1 ; 80 ; free documentation ; gnu free documentation licen[cs]e (?:version |v )?v?1 1
gfdl ; 70 ; free documentation ; (?:gnu )?free documentation licen[cs]e
gfdl ; 50 ; gfdl ; (?:gnu )?gfdl
bsd-2-clause ; 80 ; bsd ; (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
bsd-3-clause ; 80 ; bsd ; (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-4-clause ; 80 ; bsd ; (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[cs]e)?
bsd-0-clause ; 80 ; bsd ; (?:0bsd|bsd 0 clause|0 clause bsd|zero clause bsd)(?: licen[cs]e)?
bsd-any ; 70 ; bsd ; bsd(?: style)? licen[cs]e
bsd-any ; 60 ; redistribution and use ; redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause ; 60 ; endorse or promote ; may be used to endorse or promote products derived from this software
bsd-4-clause ; 60 ; advertising materials ; all advertising materials mentioning features or use of this software
bsd-any ; 30 ; neither the name ; neither the name of the (?:copyright holder|university|author)
mpl-2.0 ; 90 ; mozilla public ; (?:subject to|under) the terms of the mozilla public licen[cs]e v(?:ersion)? 2 0
mpl-2.0 ; 80 ; mozilla public ; mozilla public licen[cs]e (?:version |v )?v?2(?: 0)?
mpl-1.1 ; 80 ; mozilla public ; mozilla public licen[cs]e (?:version |v )?v?1 1
mpl-1.0 ; 80 ; mozilla public ; mozilla public licen[cs]e (?:version |v )?v?1 0
mpl-any ; 70 ; mozilla public ; mozilla public licen[cs]e
mpl-2.0 ; 60 ; mpl ; mpl ?(?:version |v )?v?2(?: 0)?
mpl-1.1 ; 60 ; mpl ; mpl ?(?:version |v )?v?1 1
epl-2.0 ; 80 ; eclipse public ; eclipse public licen[cs]e (?:version |v )?v?2(?: 0)?
epl-1.0 ; 80 ; eclipse public ; eclipse public licen[cs]e (?:version |v )?v?1(?: 0)?
epl-any ; 70 ; eclipse public ; eclipse public licen[cs]e
epl-2.0 ; 60 ; epl ; epl ?(?:version |v )?v?2(?: 0)?
edl-1.0 ; 70 ; eclipse distribution ; eclipse distribution licen[cs]e(?: (?:version |v )?v?1 0)?
cpl-1.0 ; 70 ; common public licen ; (?:ibm )?common public licen[cs]e(?: (?:version |v )?v?1 0)?
ipl-1.0 ; 70 ; ibm public licen ; ibm public licen[cs]e(?: (?:version |v )?v?1 0)?
cddl-1.1 ; 80 ; common development and distribution ; common development and distribution licen[cs]e (?:version |v )?v?1 1
cddl-1.0 ; 80 ; common development and distribution ; common development and distribution licen[cs]e (?:version |v )?v?1 0
cddl-any ; 70 ; common development and distribution ; common development and distribution licen[cs]e
cddl-any ; 50 ; cddl ; cddl(?: 1 [01])?
cpal-1.0 ; 70 ; common public attribution ; common public attribution licen[cs]e(?: (?:version |v )?v?1 0)?
cc-by-nc-nd-4.0 ; 90 ; cc by ; cc by nc nd 4(?: 0)?
cc-by-nc-nd-3.0 ; 90 ; cc by ; cc by nc nd 3(?: 0)?
cc-by-nc-nd ; 85 ; cc by ; cc by nc nd(?: 2 5| 2 0| 1 0)?
cc-by-nc-sa-4.0 ; 90 ; cc by ; cc by nc sa 4(?: 0)?
cc-by-nc-sa-3.0 ; 90 ; cc by ; cc by nc sa 3(?: 0)?
cc-by-nc-sa ; 85 ; cc by ; cc by nc sa(?: 2 5| 2 0| 1 0)?
cc-by-nc-4.0 ; 84 ; cc by ; cc by nc 4(?: 0)?
cc-by-nc-3.0 ; 84 ; cc by ; cc by nc 3(?: 0)?
cc-by-nc-2.0 ; 84 ; cc by ; cc by nc 2(?: [05])?
cc-by-nc ; 80 ; cc by ; cc by nc
cc-by-sa-4.0 ; 84 ; cc by ; cc by sa 4(?: 0)?
cc-by-sa-3.0 ; 84 ; cc by ; cc by sa 3(?: 0)?
cc-by-sa-2.0 ; 84 ; cc by ; cc by sa 2(?: [05])?
cc-by-sa ; 80 ; cc by ; cc by sa
cc-by-nd-4.0 ; 84 ; cc by ; cc by nd 4(?: 0)?
cc-by-nd-3.0 ; 84 ; cc by ; cc by nd 3(?: 0)?
cc-by-nd ; 80 ; cc by ; cc by nd
cc-by-4.0 ; 78 ; cc by ; cc by 4(?: 0)?
cc-by-3.0 ; 78 ; cc by ; cc by 3(?: 0)?
cc-by-2.0 ; 78 ; cc by ; cc by 2(?: [05])?
cc-by-any ; 70 ; cc by ; cc by
cc0-1.0 ; 80 ; cc0 ; cc0(?: 1 0)?(?: universal)?
cc0-1.0 ; 80 ; creative commons zero ; creative commons zero(?: (?:version |v )?v?1 0)?(?: universal)?
cc-pdm ; 70 ; public domain mark ; (?:creative commons )?public domain mark(?: 1 0)?
cc-by-nc-nd ; 85 ; creative commons ; creative commons (?:attribution|by) non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc-sa ; 85 ; creative commons ; creative commons (?:attribution|by) non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc ; 82 ; creative commons ; creative commons (?:attribution|by) non ?commercial(?: [1-4] [05])?
cc-by-sa ; 82 ; creative commons ; creative commons (?:attribution|by) share ?alike(?: [1-4] [05])?
cc-by-nd ; 82 ; creative commons ; creative commons (?:attribution|by) no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-4.0 ; 80 ; creative commons ; creative commons attribution 4 0(?: international)?
cc-by-3.0 ; 80 ; creative commons ; creative commons attribution 3 0(?: unported)?
cc-by-any ; 75 ; creative commons ; creative commons attribution(?: licen[cs]e)?
cc-any ; 50 ; creative commons ; creative commons(?: licen[cs]e)?
cc-any ; 60 ; creativecommons org ; creativecommons org licenses [a-z0-9 ]{2,20}?(?: [1-4] [05])?
cc-sampling ; 70 ; sampling plus ; (?:creative commons )?sampling plus(?: 1 0)?
isc ; 70 ; isc licen ; isc licen[cs]e
isc ; 60 ; permission to use copy modify ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib ; 70 ; zlib ; zlib(?: libpng)? licen[cs]e
zlib ; 60 ; altered source versions ; altered source versions must be plainly marked as such
libpng ; 70 ; libpng ; libpng licen[cs]e(?: version 2)?
unlicense ; 80 ; unlicense ; (?:the )?unlicense(?: org)?
unlicense ; 60 ; released into the public domain ; this is free and unencumbered software released into the public domain
public-domain ; 60 ; public domain ; (?:placed|dedicated|released|put|is) (?:in|in to|into|to) the public domain
public-domain ; 40 ; public domain ; public domain(?: dedication)?
wtfpl ; 80 ; do what the ; do what the f[a-z]* you want to public licen[cs]e(?: version 2)?
wtfpl ; 60 ; wtfpl ; wtfpl
artistic-2.0 ; 80 ; artistic licen ; artistic licen[cs]e (?:version |v )?v?2(?: 0)?
artistic-1.0 ; 80 ; artistic licen ; artistic licen[cs]e (?:version |v )?v?1(?: 0)?
artistic-any ; 70 ; artistic licen ; (?:the )?(?:perl )?artistic licen[cs]e
perl ; 60 ; perl itself ; under the same terms as perl itself
psf-2.0 ; 80 ; python software foundation ; python software foundation licen[cs]e(?: (?:version |v )?v?2)?
psf-any ; 60 ; psf licen ; psf licen[cs]e
cnri-python ; 70 ; cnri ; cnri (?:open source )?(?:python )?licen[cs]e
boost-1.0 ; 80 ; boost software ; boost software licen[cs]e(?: (?:version |v )?v?1 0)?
boost-1.0 ; 60 ; bsl 1 0 ; bsl 1 0
ofl-1.1 ; 80 ; open font ; (?:sil )?open font licen[cs]e(?: (?:version |v )?v?1 1)?
ofl-1.1 ; 50 ; ofl ; ofl 1 1
openssl ; 70 ; openssl licen ; openssl licen[cs]e
ssleay ; 70 ; ssleay ; (?:original )?ssleay licen[cs]e
postgresql ; 70 ; postgresql licen ; postgresql licen[cs]e
ms-pl ; 80 ; microsoft public ; microsoft public licen[cs]e(?: ms pl)?
ms-rl ; 80 ; microsoft reciprocal ; microsoft reciprocal licen[cs]e(?: ms rl)?
ms-eula ; 60 ; end user ; (?:microsoft )?end user licen[cs]e agreement
eupl-1.2 ; 80 ; european union public ; european union public licen[cs]e (?:version |v )?v?1 2
eupl-1.1 ; 80 ; european union public ; european union public licen[cs]e (?:version |v )?v?1 1
eupl-any ; 70 ; european union public ; european union public licen[cs]e
eupl-any ; 50 ; eupl ; eupl(?: v?1 [12])?
cecill-2.1 ; 80 ; cecill ; cecill (?:free software )?(?:licen[cs]e )?(?:agreement )?(?:version |v )?v?2 1
cecill-b ; 80 ; cecill ; cecill b(?: licen[cs]e)?
cecill-c ; 80 ; cecill ; cecill c(?: licen[cs]e)?
cecill-any ; 60 ; cecill ; cecill(?: licen[cs]e)?
licence-ouverte ; 70 ; licence ouverte ; licence ouverte(?: etalab)?(?: 2 0)?
etalab ; 70 ; etalab ; etalab (?:open )?licen[cs]e(?: 2 0)?
busl-1.1 ; 80 ; business source ; business source licen[cs]e(?: (?:version |v )?v?1 1)?
sspl-1.0 ; 80 ; server side public ; server side public licen[cs]e(?: (?:version |v )?v?1(?: 0)?)?
elastic-2.0 ; 80 ; elastic licen ; elastic licen[cs]e(?: (?:version |v )?v?2 0)?
commons-clause ; 80 ; commons clause ; commons clause(?: licen[cs]e)?(?: condition)?
polyform-nc ; 80 ; polyform ; polyform noncommercial licen[cs]e(?: 1 0 0)?
polyform-any ; 70 ; polyform ; polyform (?:small business|shield|strict|perimeter|internal use) licen[cs]e
odbl-1.0 ; 80 ; open database ; (?:odc )?open database licen[cs]e(?: odbl)?(?: (?:version |v )?v?1 0)?
odbl-1.0 ; 60 ; odbl ; odbl(?: 1 0)?
odc-by-1.0 ; 80 ; open data commons ; open data commons (?:by|attribution)(?: licen[cs]e)?(?: (?:version |v )?v?1 0)?
odc-by-1.0 ; 80 ; odc ; odc (?:by|attribution)(?: licen[cs]e)?(?: (?:version |v )?v?1 0)?
pddl-1.0 ; 80 ; public domain dedication ; (?:odc )?public domain dedication and licen[cs]e(?: 1 0)?
cdla-permissive ; 80 ; community data license ; community data license agreement permissive(?: (?:version )?[12] 0)?
cdla-sharing ; 80 ; community data license ; community data license agreement sharing(?: (?:version )?1 0)?
ogl-uk-3.0 ; 80 ; open government ; open government licen[cs]e (?:version |v )?v?3(?: 0)?
ogl-uk-2.0 ; 80 ; open government ; open government licen[cs]e (?:version |v )?v?2(?: 0)?
ogl-any ; 70 ; open government ; open government licen[cs]e
dl-de-by-2.0 ; 80 ; datenlizenz deutschland ; datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?
dl-de-zero-2.0 ; 80 ; datenlizenz deutschland ; datenlizenz deutschland zero(?: version)?(?: 2 0)?
ruby ; 70 ; ruby ; ruby(?: s)? licen[cs]e
php-3.01 ; 80 ; php licen ; php licen[cs]e (?:version |v )?v?3 0?1
php-any ; 70 ; php licen ; php licen[cs]e
zend-2.0 ; 70 ; zend ; zend (?:engine )?licen[cs]e(?: (?:version |v )?v?2 0)?
lppl-1.3c ; 80 ; project public ; latex project public licen[cs]e (?:version |v )?v?1 3[abc]?
lppl-any ; 70 ; project public ; latex project public licen[cs]e
zpl-2.1 ; 70 ; zope public ; zope public licen[cs]e(?: (?:version |v )?v?2 [01])?
w3c ; 70 ; w3c ; w3c (?:software (?:notice )?(?:and )?(?:document )?)?licen[cs]e
ncsa ; 70 ; ncsa ; (?:university of illinois )?ncsa (?:open source )?licen[cs]e
afl-3.0 ; 80 ; academic free ; academic free licen[cs]e (?:version |v )?v?3(?: 0)?
afl-any ; 70 ; academic free ; academic free licen[cs]e
osl-3.0 ; 80 ; open software licen ; open software licen[cs]e (?:version |v )?v?3(?: 0)?
osl-any ; 70 ; open software licen ; open software licen[cs]e
qpl-1.0 ; 70 ; q public ; q public licen[cs]e(?: (?:version |v )?v?1 0)?
sleepycat ; 70 ; sleepycat ; sleepycat licen[cs]e
vim ; 70 ; vim licen ; vim licen[cs]e
json ; 60 ; for good not evil ; the software shall be used for good not evil
beerware ; 70 ; beer ; (?:the )?beer ?ware licen[cs]e
blueoak-1.0.0 ; 80 ; blue oak ; blue oak model licen[cs]e(?: 1 0 0)?
upl-1.0 ; 80 ; universal permissive ; universal permissive licen[cs]e(?: (?:version |v )?v?1 0)?
ntp ; 70 ; ntp licen ; ntp licen[cs]e
icu ; 70 ; icu licen ; icu licen[cs]e
unicode-3.0 ; 70 ; unicode ; unicode (?:inc )?licen[cs]e (?:agreement|v3|version 3)
curl ; 70 ; curl licen ; curl licen[cs]e
ijg ; 70 ; independent jpeg group ; (?:the )?independent jpeg group(?: s)?(?: licen[cs]e)?
ftl ; 70 ; freetype ; freetype (?:project )?licen[cs]e
bzip2 ; 70 ; bzip2 ; bzip2 licen[cs]e
info-zip ; 70 ; info zip ; info zip licen[cs]e
apsl-2.0 ; 80 ; apple public source ; apple public source licen[cs]e(?: (?:version |v )?v?[12] [012])?
rpl-1.5 ; 70 ; reciprocal public ; reciprocal public licen[cs]e(?: 1 [15])?
sgi-b-2.0 ; 70 ; sgi free software ; sgi free software licen[cs]e b(?: (?:version |v )?v?[12] [01])?
intel ; 70 ; intel ; intel (?:open source|simplified software) licen[cs]e
nasa-1.3 ; 70 ; nasa open source ; nasa open source agreement(?: 1 3)?
lal-1.3 ; 70 ; art libre ; (?:licence|license) art libre(?: 1 [23])?
free-art-1.3 ; 70 ; free art licen ; free art licen[cs]e(?: 1 [23])?
dfsl ; 70 ; deutsche freie software ; deutsche freie software lizenz
against-drm ; 70 ; against drm ; against drm(?: 2 0)?(?: licen[cs]e)?
watcom-1.0 ; 70 ; watcom ; (?:sybase )?open watcom public licen[cs]e(?: 1 0)?
multics ; 70 ; multics ; multics licen[cs]e
motosoto ; 70 ; motosoto ; motosoto open source licen[cs]e
nokia ; 70 ; nokia open source ; nokia open source licen[cs]e
ecl-2.0 ; 80 ; educational community ; educational community licen[cs]e(?: (?:version |v )?v?[12] 0)?
entessa ; 70 ; entessa ; entessa public licen[cs]e
frameworx ; 70 ; frameworx ; frameworx open licen[cs]e
hpnd ; 60 ; historical permission ; historical permission notice and disclaimer
lpl-1.02 ; 70 ; lucent public ; lucent public licen[cs]e(?: (?:version |v )?v?1 0?2?)?
naumen ; 70 ; naumen ; naumen public licen[cs]e
ospl ; 70 ; openldap public ; openldap public licen[cs]e(?: 2 8)?
catosl ; 70 ; computer associates ; computer associates trusted open source licen[cs]e
spl-1.0 ; 70 ; sun public ; sun public licen[cs]e(?: (?:version |v )?v?1 0)?
sissl ; 70 ; sun industry standards ; sun industry standards source licen[cs]e
openrail-m ; 80 ; rail ; (?:bigscience |creativeml )?open ?rail(?: m| s| ms)?(?: licen[cs]e)?
llama-community ; 70 ; community license agreement ; llama [0-9]+(?: [0-9]+)? community license agreement
proprietary ; 60 ; proprietary ; (?:this (?:software|document|material|work) is )?(?:confidential and proprietary|proprietary and confidential)
proprietary ; 50 ; proprietary ; proprietary licen[cs]e
no-redistribution ; 60 ; may not be ; may not be (?:reproduced|copied|redistributed|republished)(?: or [a-z]+)?(?: in any form)?(?: without (?:the )?(?:prior )?(?:written )?(?:permission|consent))?
no-redistribution ; 55 ; no part of this ; no part of this (?:publication|book|document|work|site) may be (?:reproduced|copied|transmitted)
non-commercial ; 50 ; commercial use ; (?:for )?non ?commercial use only
non-commercial ; 45 ; commercial use ; (?:not for|no) commercial use
permission-required ; 45 ; permission ; (?:used|reprinted|reproduced) (?:with|by) permission
all-rights-reserved ; 40 ; rights reserved ; all rights reserved
some-rights-reserved ; 40 ; rights reserved ; some rights reserved
all-rights-reserved ; 40 ; rechte vorbehalten ; alle rechte vorbehalten
all-rights-reserved ; 40 ; tous droits ; tous droits (?:de reproduction )?r\xc3\xa9serv\xc3\xa9s
all-rights-reserved ; 40 ; derechos reservados ; (?:todos los )?derechos reservados
copyright-notice ; 30 ; copyright ; copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])*
copyright-notice ; 20 ; copyright ; copyright(?: by| c)?
licence-reference ; 20 ; see the licen ; see the licen[cs]e(?: file)?(?: for)?
licence-reference ; 10 ; license ; (?:licensed|released|distributed|available) under (?:the |a |an )?[^ ]+(?: [^ ]+)? license
licence-reference ; 10 ; licensed under ; licensed under
spdx-identifier ; 20 ; spdx license identifier ; spdx license identifier [^ ]+
warranty-disclaimer ; 30 ; without warrant ; without warrant(?:y|ies)(?: or conditions)? of any kind
warranty-disclaimer ; 30 ; as is ; (?:is )?provided (?:by the [a-z ]{3,40})?as is
liability-disclaimer ; 30 ; in no event shall ; in no event shall (?:the )?(?:authors?|copyright holders?|contributors?|regents)
"""
