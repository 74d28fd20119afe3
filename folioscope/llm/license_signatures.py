"""Signatures of licenses, written by hand: label | keyword that every match contains | regular expression.

Expressions are over a text's lower-cased words, joined by single spaces: `2.0` is `2 0`, and a `+` after a number stays with
it. A group in an expression is the part that counts as the place. Sections go from the surest to the least sure.
"""

from __future__ import annotations

#: Sentences of license texts and of the notices that they ask for.
GRANTS = r"""
mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-modern | without written agreement | permission is hereby granted without written agreement and without licen[cs]e or royalty fees
x11 | advertising | except as contained in this notice the name of (?:the )?[a-z0-9 ]{1,60} shall not be used in advertising or otherwise to promote the sale
mit-0 | without restriction | to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
bsl-1.0 | organization obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | permission to use | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
0bsd | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | permission to use | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?(?:with or )?without fee is hereby granted
ntp | permission to use | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies
postgresql | without a written agreement | without fee and without a written agreement is hereby granted
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse or promote | neither the name of (?:the )?[a-z0-9 ]{1,60} nor the names of (?:its|the)? ?contributors may be used to endorse or promote products
bsd-3-clause | endorse or promote | the names? of (?:the )?(?:author|copyright holders?) may not be used to endorse or promote products derived from this software
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment
bsd-3-clause-clear | patent rights | no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e
bsd-source-code | source code must retain | redistributions of source code must retain the above copyright notice
bsd | binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | plainly marked | altered source versions must be plainly marked as such and must not be misrepresented
libpng | png reference library | the png reference library is supplied as is
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
apache-2.0 | in compliance with | licensed under the apache licen[cs]e version 2 0 the license you may not use this file except in compliance with the licen[cs]e
apache-2.0 | in compliance with | you may not use this file except in compliance with the licen[cs]e
apache-2.0 | without warranties or conditions | distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-2.0 | patent litigation | if you institute patent litigation against any entity including a cross claim or counterclaim in a lawsuit
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
apache-1.0 | apache group | this product includes software developed by the apache group for use in the apache http server project
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric young | this product includes cryptographic software written by eric young
gpl-2.0-or-later | either version 2 | under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or (?:\(?at your option\)? )?any later version
gpl-3.0-or-later | either version 3 | under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or (?:\(?at your option\)? )?any later version
gpl-2.0 | version 2 | under the terms of the gnu general public licen[cs]e version 2(?: 0)? (?:only )?as published by the free software foundation
gpl-3.0 | version 3 | under the terms of the gnu general public licen[cs]e version 3(?: 0)? (?:only )?as published by the free software foundation
lgpl-2.0-or-later | either version 2 | gnu (?:library|lesser) general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or (?:at your option )?any later version
lgpl-2.1-or-later | either version 2 1 | gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or (?:at your option )?any later version
lgpl-3.0-or-later | either version 3 | gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or (?:at your option )?any later version
agpl-3.0-or-later | either version 3 | gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or (?:at your option )?any later version
gpl | redistribute it | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
lgpl | redistribute it | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
agpl | redistribute it | you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
gpl | to share and change | the licen[cs]es for most software (?:and other practical works )?are designed to take away your freedom to share and change
gpl | received a copy | you should have received a copy of the gnu general public licen[cs]e along with
lgpl | received a copy | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with
agpl | received a copy | you should have received a copy of the gnu affero general public licen[cs]e along with
agpl-3.0 | interacting with it remotely | all users interacting with it remotely through a computer network
gpl-2.0-with-classpath-exception | linking this library | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-with-gcc-exception | gcc runtime library exception | gcc runtime library exception
gpl-with-openssl-exception | openssl | special exception (?:[a-z0-9]+ ){0,40}?link (?:[a-z0-9]+ ){0,20}?with the openssl (?:project s )?(?:openssl )?library
gpl-with-bison-exception | bison parser skeleton | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gpl-with-autoconf-exception | configuration script | as a special exception (?:[a-z0-9]+ ){0,40}?configuration script generated by autoconf
gfdl | gnu free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
mpl-2.0 | mozilla org mpl 2 0 | if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0
mpl-2.0 | mozilla public | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-1.1 | mozilla public | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
npl-1.1 | netscape public | the contents of this file are subject to the netscape public licen[cs]e version 1 1
epl-1.0 | eclipse public | made available under the terms of the eclipse public licen[cs]e v ?1 0
epl-2.0 | eclipse public | made available under the terms of the eclipse public licen[cs]e (?:v ?)?2 0
cddl | common development | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
cpl-1.0 | common public | made available under the terms of the common public licen[cs]e v ?1 0
eupl-1.2 | eupl | licensed under the eupl (?:v ?|version )?1 2
artistic | standard version | the standard version of (?:the|this) package
perl | same terms as perl | under the same terms as perl(?: itself)?
ruby | ruby | under (?:the )?(?:ruby s licen[cs]e|the same terms as ruby)
python-2.0 | psf hereby | psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e
php-3.01 | php software | this product includes php software freely available from
zpl | zope corporation | this software consists of contributions made by zope corporation
ofl-1.1 | open font | this font software is licensed under the sil open font licen[cs]e version 1 1
ofl | reserved font name | with reserved font names? [a-z0-9]+
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
cc0-1.0 | waived all copyright | (?:has|have) waived all copyright and related or neighbou?ring rights
cc0-1.0 | to the extent possible under law | to the extent possible under law (?:[a-z0-9]+ ){0,12}?waived all copyright
cc | creative commons | this work is licensed under (?:a|the) creative commons
wtfpl | what the fuck | you just do what the fuck you want to
beerware | buy me a beer | you can buy me a beer in return
json | good not evil | the software shall be used for good not evil
ncsa | deal with the software | to deal with the software without restriction including without limitation the rights to use
curl | permission to use | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
ms-pl | governs use of | this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e
afl | academic free | licensed under the academic free licen[cs]e
osl | open software | licensed under the open software licen[cs]e
w3c | this work is being | this work is being provided by the copyright holders under the following licen[cs]e
unicode | unicode data files | any person obtaining a copy of the unicode data files and any associated documentation
icu | icu licen | icu licen[cs]e icu 1 8 1 and later
sspl-1.0 | service source code | you must make the service source code available via network download to everyone at no charge
busl-1.1 | change licen | effective on the change date (?:[a-z0-9]+ ){0,20}?the licensor hereby grants you rights under the terms of the change licen[cs]e
busl-1.1 | business source | use of this software is governed by the business source licen[cs]e
elastic-2.0 | managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | right to sell | the licen[cs]e does not grant to you the right to sell the software
openrail | use based restrictions | use based restrictions as referenced in paragraph 5
llama | llama | licensed under the (?:meta )?llama (?:2|3|3 1|3 2|3 3|4) community licen[cs]e
public-domain | public domain | (?:is|are|been)(?: hereby)? (?:released|placed|dedicated) (?:in|in to|to|into) the public domain
public-domain | public domain | (?:i|we) (?:hereby )?(?:release|place|dedicate) this (?:[a-z0-9]+ ){1,4}?(?:in|to|into) the public domain
public-domain | public domain | this (?:file|code|work|software|program) is (?:in the )?public domain
proprietary | confidential and proprietary | confidential and proprietary
proprietary | written permission | may not be (?:copied|reproduced|used|distributed)(?: or (?:copied|reproduced|used|distributed))* without (?:the )?(?:express )?(?:prior )?written permission
proprietary | unauthori | unauthori[sz]ed copying of this file via any medium is strictly prohibited
eula | end user licen | end user licen[cs]e agreement
all-rights-reserved | rights reserved | all rights reserved
no-commercial-use | non commercial | for non commercial (?:use|purposes) only
no-commercial-use | noncommercial | for noncommercial (?:use|purposes) only
research-only | research purposes | for (?:academic |non commercial )?research purposes only
"""

#: Identifiers, short forms and addresses that name a license and its version.
VERSIONED = r"""
apache-2.0 | apache | apache (?:licen[cs]e )?(?:version |v ?)?2(?: 0)?
apache-2.0 | apache 2 | licensed under (?:the )?apache 2(?: 0)?
apache-2.0 | apache org licenses | apache org licenses licen[cs]e 2 0
apache-2.0 | al2 | al2 0
apache-2.0 | apachev2 | apachev2(?: 0)?
apache-2.0 | apache2 | apache2(?: 0)?(?: licen[cs]e)?
apache-1.1 | apache 1 1 | apache 1 1
apache-1.0 | apache 1 0 | apache 1 0
gpl-1.0-or-later | gpl | gpl (?:v ?)?1(?: 0)?\+
gpl-2.0-or-later | gpl | (?:gnu )?gpl (?:v ?|version )?2(?: 0)?\+
gpl-2.0-or-later | gplv2 | (?:gnu )?gplv2(?: 0)?(?:\+| or (?:any )?(?:later|newer|above|higher)(?: version)?)
gpl-2.0-or-later | gpl2 | gpl2\+
gpl-2.0 | gplv2 | (?:gnu )?gplv2(?: 0)?(?: only)?
gpl-2.0 | gpl2 | gpl2
gpl-2.0 | gnu org licenses | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0-or-later | gpl | (?:gnu )?gpl (?:v ?|version )?3(?: 0)?\+
gpl-3.0-or-later | gplv3 | (?:gnu )?gplv3(?: 0)?(?:\+| or (?:any )?(?:later|newer|above|higher)(?: version)?)
gpl-3.0-or-later | gpl3 | gpl3\+
gpl-3.0 | gplv3 | (?:gnu )?gplv3(?: 0)?(?: only)?
gpl-3.0 | gpl3 | gpl3
gpl-3.0 | gnu org licenses | gnu org licenses gpl 3 0
lgpl-2.0-or-later | lgpl | (?:gnu )?lgpl (?:v ?|version )?2(?: 0)?\+
lgpl-2.0-or-later | lgplv2 | (?:gnu )?lgplv2(?: 0)?(?:\+| or (?:any )?later(?: version)?)
lgpl-2.0 | lgplv2 | (?:gnu )?lgplv2(?: 0)?(?: only)?
lgpl-2.1-or-later | lgpl | (?:gnu )?lgpl (?:v ?|version )?2 1\+
lgpl-2.1-or-later | lgplv2 | (?:gnu )?lgplv2 1(?:\+| or (?:any )?(?:later|newer|above|higher)(?: version)?)
lgpl-2.1 | lgplv2 | (?:gnu )?lgplv2 1(?: only)?
lgpl-2.1 | gnu org licenses | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0-or-later | lgpl | (?:gnu )?lgpl (?:v ?|version )?3(?: 0)?\+
lgpl-3.0-or-later | lgplv3 | (?:gnu )?lgplv3(?: 0)?(?:\+| or (?:any )?(?:later|newer|above|higher)(?: version)?)
lgpl-3.0 | lgplv3 | (?:gnu )?lgplv3(?: 0)?(?: only)?
lgpl-3.0 | gnu org licenses | gnu org licenses lgpl 3 0
agpl-3.0-or-later | agpl | (?:gnu )?agpl (?:v ?|version )?3(?: 0)?\+
agpl-3.0-or-later | agplv3 | (?:gnu )?agplv3(?: 0)?(?:\+| or (?:any )?(?:later|newer|above|higher)(?: version)?)
agpl-3.0 | agplv3 | (?:gnu )?agplv3(?: 0)?(?: only)?
agpl-3.0 | agpl3 | agpl3
agpl-3.0 | gnu org licenses | gnu org licenses agpl 3 0
gfdl-1.2 | gfdlv1 | gfdlv1 2
gfdl-1.3 | gfdlv1 | gfdlv1 3
mpl-1.1 | mplv1 | mplv1 1
mpl-2.0 | mplv2 | mplv2(?: 0)?
mpl-2.0 | mpl2 | mpl2(?: 0)?
mpl-2.0 | mozilla org | mozilla org (?:en us )?mpl 2 0
epl-1.0 | eplv1 | eplv1(?: 0)?
epl-2.0 | eplv2 | eplv2(?: 0)?
epl-1.0 | eclipse org legal | eclipse org legal epl v10
epl-2.0 | eclipse org legal | eclipse org legal epl 2 0
cddl-1.0 | cddlv1 | cddlv1(?: 0)?
eupl-1.1 | euplv1 | euplv1 1
eupl-1.2 | euplv1 | euplv1 2
artistic-2.0 | artistic 2 | artistic 2(?: 0)?
artistic-1.0 | artistic 1 | artistic 1(?: 0)?
bsl-1.0 | boost | boost (?:software )?licen[cs]e (?:version |v ?)?1 0
bsl-1.0 | bsl 1 0 | bsl 1 0
bsl-1.0 | boost org licen | boost org licen[cs]e 1 0
bsd-2-clause | bsd 2 | bsd 2(?: clause)?
bsd-2-clause | bsd2 | bsd2
bsd-3-clause | bsd 3 | bsd 3(?: clause)?
bsd-3-clause | bsd3 | bsd3
bsd-4-clause | bsd 4 | bsd 4(?: clause)?
bsd-4-clause | 4 clause bsd | 4 clause bsd(?: licen[cs]e)?
bsd-4-clause | original bsd | original bsd licen[cs]e
0bsd | 0bsd | 0bsd
0bsd | zero clause bsd | zero clause bsd(?: licen[cs]e)?
bsd-1-clause | bsd 1 clause | bsd 1 clause
mit-0 | mit 0 | mit 0
mit-0 | mit no attribution | mit no attribution
x11 | x11 licen | x11 licen[cs]e
cc0-1.0 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-pdm | publicdomain mark | creativecommons org publicdomain mark 1 0
cc0-1.0 | cc0 | cc0 1 0(?: universal)?
pddl-1.0 | pddl | pddl(?: v)?(?: 1 0)?
odbl-1.0 | odbl 1 0 | odbl 1 0
odc-by-1.0 | odc by | odc by(?: 1 0)?
ofl-1.1 | ofl | ofl (?:version |v ?)?1 1
ofl-1.1 | scripts sil org ofl | scripts sil org ofl
ms-pl | ms pl | ms pl
ms-rl | ms rl | ms rl
unlicense | unlicense org | unlicense org
wtfpl-2.0 | wtfpl | wtfpl (?:version |v ?)?2(?: 0)?
python-2.0 | python 2 0 | python 2 0(?: 1)? licen[cs]e
php-3.01 | php licen | php licen[cs]e (?:version |v ?)?3 01
zpl-2.1 | zpl 2 1 | zpl 2 1
sspl-1.0 | sspl | sspl(?: v ?1| 1 0)?
busl-1.1 | busl 1 1 | busl 1 1
elastic-2.0 | elastic licen | elastic licen[cs]e (?:v ?)?2(?: 0)?
ncsa | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[cs]e
postgresql | postgresql licen | postgresql licen[cs]e
openssl | openssl licen | openssl licen[cs]e
qpl-1.0 | q public | q public licen[cs]e(?: version)?(?: 1 0)?
vim | vim licen | vim licen[cs]e
w3c | w3c software | w3c software (?:and document )?(?:notice and )?licen[cs]e
hpnd | historical permission notice | historical permission notice and disclaimer
upl-1.0 | universal permissive | universal permissive licen[cs]e(?: v ?1 0)?
blueoak-1.0.0 | blue oak | blue oak model licen[cs]e 1 0 0
mulan-psl-2.0 | mulan | mulan (?:permissive software licen[cs]e|psl) v ?2
ecl-2.0 | educational community | educational community licen[cs]e (?:version )?2 0
lppl-1.3c | latex project public | latex project public licen[cs]e
ipl-1.0 | ibm public | ibm public licen[cs]e(?: version)?(?: 1 0)?
spl-1.0 | sun public | sun public licen[cs]e(?: version)?(?: 1 0)?
cpal-1.0 | common public attribution | common public attribution licen[cs]e(?: version)?(?: 1 0)?
rpl-1.5 | reciprocal public | reciprocal public licen[cs]e(?: 1 5)?
hippocratic | hippocratic | hippocratic licen[cs]e
openrail-m | openrail | (?:creativeml |bigscience )?openrail m
openrail | bigscience | bigscience (?:bloom )?rail(?: 1 0)?(?: licen[cs]e)?
llama | llama | llama (?:2|3|3 1|3 2|3 3|4) community licen[cs]e
gemma | gemma terms | gemma terms of use
"""

#: Licenses in an SPDX expression after its tag, where the identifier alone would say too little.
EXPRESSIONS = r"""
mit | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(mit)(?= (?!0 ))
isc | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(isc)
zlib | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(zlib)
unlicense | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(unlicense)
wtfpl | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(wtfpl)
x11 | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(x11)
ncsa | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(ncsa)
curl | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(curl)
json | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(json)
ruby | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(ruby)
vim | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(vim)
icu | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(icu)
ijg | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(ijg)
libpng | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(libpng)
openssl | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(openssl)
postgresql | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(postgresql)
beerware | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(beerware)
hpnd | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(hpnd)
ntp | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(ntp)
w3c | spdx | spdx license identifier (?:[a-z0-9+]+ ){0,14}?(w3c)
"""

#: Short names without a version.
NAMES = r"""
apache | apache | (?:licensed|released|available|distributed) under (?:the )?apache
mit | mit | (?:licensed|released|available|distributed) under (?:the )?(?:terms of the )?mit(?= (?!licen|0 ))
mit | mit expat | mit expat
mit | mit | licen[cs]e mit
bsd | bsd | licen[cs]e bsd
gpl | gpl | licen[cs]e gpl
bsd | bsd | bsd (?:style|like)(?: licen[cs]e)?
beerware | beerware | beerware(?: licen[cs]e)?
ruby | ruby licen | ruby licen[cs]e
perl | artistic or gpl | artistic or gpl
cc | creative commons | creative commons licen[cs]e
all-rights-reserved | tous droits | tous droits réservés
all-rights-reserved | alle rechte | alle rechte vorbehalten
all-rights-reserved | todos los derechos | todos los derechos reservados
"""
