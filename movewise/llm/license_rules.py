"""Signature rules of licences: label; kind; keywords; expression over a text's terms, joined by one space.

Keywords are terms that every match of the expression holds, so a text without them need not be tried.
Expressions are written for lower-case terms: punctuation has gone, so "GPL-3.0" reads "gpl 3 0". They match
whole terms. The order of rules is their order of preference within a kind.
"""

#: Kinds with their priority and how sure a match of that kind alone makes: a tag written for machines, a
#: passage of the licence, a notice that grants it, its name, a mere hint.
KINDS = {"tag": (5, 1.0), "text": (4, 1.0), "notice": (3, 0.95), "name": (2, 0.8), "hint": (1, 0.4)}

RULES = r"""
agpl-3.0-or-later; tag; spdx agpl; spdx license identifier agpl 3 0 or later
agpl-3.0-only; tag; spdx agpl; spdx license identifier agpl 3 0(?: only)?
gpl-1.0-or-later; tag; spdx gpl; spdx license identifier gpl 1 0 or later
gpl-1.0-only; tag; spdx gpl; spdx license identifier gpl 1 0(?: only)?
gpl-2.0-or-later; tag; spdx gpl; spdx license identifier gpl 2 0 or later
gpl-2.0-only; tag; spdx gpl; spdx license identifier gpl 2 0(?: only)?
gpl-3.0-or-later; tag; spdx gpl; spdx license identifier gpl 3 0 or later
gpl-3.0-only; tag; spdx gpl; spdx license identifier gpl 3 0(?: only)?
lgpl-2.0-or-later; tag; spdx lgpl; spdx license identifier lgpl 2 0 or later
lgpl-2.0-only; tag; spdx lgpl; spdx license identifier lgpl 2 0(?: only)?
lgpl-2.1-or-later; tag; spdx lgpl; spdx license identifier lgpl 2 1 or later
lgpl-2.1-only; tag; spdx lgpl; spdx license identifier lgpl 2 1(?: only)?
lgpl-3.0-or-later; tag; spdx lgpl; spdx license identifier lgpl 3 0 or later
lgpl-3.0-only; tag; spdx lgpl; spdx license identifier lgpl 3 0(?: only)?
apache-2.0; tag; spdx apache; spdx license identifier apache 2 0
apache-1.1; tag; spdx apache; spdx license identifier apache 1 1
mit-0; tag; spdx mit; spdx license identifier mit 0
mit; tag; spdx mit; spdx license identifier mit
bsd-2-clause-patent; tag; spdx bsd; spdx license identifier bsd 2 clause patent
bsd-2-clause; tag; spdx bsd; spdx license identifier bsd 2 clause
bsd-3-clause-clear; tag; spdx bsd; spdx license identifier bsd 3 clause clear
bsd-3-clause; tag; spdx bsd; spdx license identifier bsd 3 clause
bsd-4-clause; tag; spdx bsd; spdx license identifier bsd 4 clause
0bsd; tag; spdx 0bsd; spdx license identifier 0bsd
isc; tag; spdx isc; spdx license identifier isc
mpl-1.1; tag; spdx mpl; spdx license identifier mpl 1 1
mpl-2.0; tag; spdx mpl; spdx license identifier mpl 2 0
epl-1.0; tag; spdx epl; spdx license identifier epl 1 0
epl-2.0; tag; spdx epl; spdx license identifier epl 2 0
cddl-1.0; tag; spdx cddl; spdx license identifier cddl 1 0
cddl-1.1; tag; spdx cddl; spdx license identifier cddl 1 1
bsl-1.0; tag; spdx bsl; spdx license identifier bsl 1 0
busl-1.1; tag; spdx busl; spdx license identifier busl 1 1
sspl-1.0; tag; spdx sspl; spdx license identifier sspl 1 0
unlicense; tag; spdx unlicense; spdx license identifier unlicense
wtfpl; tag; spdx wtfpl; spdx license identifier wtfpl
zlib; tag; spdx zlib; spdx license identifier zlib
cc0-1.0; tag; spdx cc0; spdx license identifier cc0 1 0
cc-by-nc-sa-4.0; tag; spdx cc nc sa; spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0; tag; spdx cc nc nd; spdx license identifier cc by nc nd 4 0
cc-by-nc-4.0; tag; spdx cc nc; spdx license identifier cc by nc 4 0
cc-by-nd-4.0; tag; spdx cc nd; spdx license identifier cc by nd 4 0
cc-by-sa-4.0; tag; spdx cc sa; spdx license identifier cc by sa 4 0
cc-by-sa-3.0; tag; spdx cc sa; spdx license identifier cc by sa 3 0
cc-by-4.0; tag; spdx cc; spdx license identifier cc by 4 0
cc-by-3.0; tag; spdx cc; spdx license identifier cc by 3 0
eupl-1.2; tag; spdx eupl; spdx license identifier eupl 1 2
ofl-1.1; tag; spdx ofl; spdx license identifier ofl 1 1
artistic-2.0; tag; spdx artistic; spdx license identifier artistic 2 0
upl-1.0; tag; spdx upl; spdx license identifier upl 1 0
mit; text; hereby deal restriction; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
mit; text; substantial portions; the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
bsd-3-clause; text; endorse; neither the name of(?: \S+){1,12} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause; text; advertising acknowledgement; all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-2-clause; text; binary; redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause; text; redistributions binary reproduce; redistributions in binary form must reproduce the above copyright notice
bsd-3-clause-clear; text; patent; no express or implied licenses to any party s patent rights are granted by this license
isc; text; hereby purpose fee; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
0bsd; text; hereby purpose fee; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
apache-2.0; text; licensed compliance; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0; text; contributor perpetual irrevocable; each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1.1; text; apache; this product includes software developed by the apache software foundation
gpl-2.0-or-later; text; redistribute version; free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later; text; redistribute version; free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-1.0-or-later; text; redistribute version; free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version
gpl-2.0-only; text; redistribute version; free software you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)? version 2(?: only| as published)
gpl-3.0-only; text; redistribute version; free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3
lgpl-2.1-or-later; text; lesser; terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later; text; lesser; terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.0-or-later; text; library; terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
agpl-3.0-or-later; text; affero; terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0-only; text; affero; terms of the gnu affero general public license version 3(?! of the license or)
agpl-3.0; text; remotely network; all users interacting with it remotely through a computer network
gpl; text; gnu; see the gnu general public license for more details
lgpl; text; gnu lesser; see the gnu lesser general public license for more details
agpl; text; gnu affero; see the gnu affero general public license for more details
gfdl; text; invariant; with no invariant sections no front cover texts and no back cover texts
gfdl; text; documentation; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0; text; mozilla; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1; text; mozilla contents; the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0; text; mozilla contents; the contents of this file are subject to the mozilla public license version 1 0
npl-1.1; text; netscape contents; the contents of this file are subject to the netscape public license version 1 1
cddl-1.0; text; contents common development; the contents of this file are subject to the terms of the common development and distribution license
epl-1.0; text; accompanying eclipse; this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0; text; accompanying eclipse; this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0
cpl-1.0; text; accompanying common; this program and the accompanying materials are made available under the terms of the common public license v1 0
bsl-1.0; text; hereby; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
zlib; text; misrepresented; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib; text; altered versions; altered source versions must be plainly marked as such and must not be misrepresented
unlicense; text; unencumbered; this is free and unencumbered software released into the public domain
wtfpl; text; verbatim changing; everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
cc0-1.0; text; waived neighboring; has waived all copyright and related or neighboring rights
cc0-1.0; text; affirmer; affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc-by-4.0; text; credit; you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa; text; remix transform; if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc; text; commercial purposes; you may not use the material for commercial purposes
cc-by-nd; text; remix transform; if you remix transform or build upon the material you may not distribute the modified material
artistic-2.0; text; package; this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic-1.0; text; package; the intent of this document is to state the conditions under which a package may be copied
psf-2.0; text; python psf; psf is making python available to licensee on an as is basis
python-2.0; text; beopen; beopen is making software available to licensee on an as is basis
openssl; text; openssl toolkit; this product includes software developed by the openssl project for use in the openssl toolkit
ssleay; text; eric young; this product includes cryptographic software written by eric young
php-3.01; text; php; this product includes php software freely available from
ruby; text; verbatim restriction; you may make and give away verbatim copies of the source form of the software without restriction
postgresql; text; hereby agreement; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd; text; documentation supporting; appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation
x11; text; consortium; except as contained in this notice the name of the x consortium shall not be used in advertising
ncsa; text; endorse contributors; neither the names of(?: \S+){1,20} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
w3c; text; w3c; w3c software notice and license
unicode; text; unicode data; permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
curl; text; holder; except as contained in this notice the name of a copyright holder shall not be used in advertising
ijg; text; independent jpeg; this software is based in part on the work of the independent jpeg group
libpng; text; png; the png reference library is supplied as is
ftl; text; freetype; portions of this software are copyright(?: \S+){1,6} the freetype project
ofl-1.1; text; fonts redistributed; this license allows the licensed fonts to be used studied modified and redistributed freely
ofl-1.1; text; font; this font software is licensed under the sil open font license
sspl-1.0; text; offering source; offering the program as a service(?: \S+){0,12} service source code
busl-1.1; text; licensor; the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
elastic-2.0; text; hosted managed; you may not provide the software to third parties as a hosted or managed service
commons-clause; text; grant sell; the grant of rights under the license will not include and the license does not grant to you the right to sell the software
json; text; good evil; the software shall be used for good not evil
beerware; text; beer; you can buy me a beer in return
ms-pl; text; governs accompanying; this license governs use of the accompanying software if you use the software you accept this license
eupl-1.2; text; eupl; licensed under the eupl version 1 2 or(?: as soon they will be approved by the european commission)?
cecill-2.1; text; cecill; governed by the cecill license under french law
osl-3.0; text; open software; licensed under the open software license version 3 0
afl-3.0; text; academic free; licensed under the academic free license version 3 0
openrail; text; use; use based restrictions(?: \S+){0,20} attachment a
llama-community; text; llama community; llama (?:\S+ ){0,2}is licensed under the llama(?: \S+){0,3} community license
agpl-3.0; notice; affero; (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? (?:gnu )?affero general public license(?: as published by the free software foundation)? (?:version |v ?)?3(?: 0)?
agpl-3.0; notice; agpl; (?:licensed|released|distributed|available) under(?: the)? agpl ?v?3(?: 0)?
agpl-3.0; notice; agplv3; (?:licensed|released|distributed|available) under(?: the)? agplv3
lgpl-3.0; notice; lesser; (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? (?:gnu )?lesser general public license (?:version |v ?)?3(?: 0)?
lgpl-2.1; notice; lesser; (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? (?:gnu )?lesser general public license (?:version |v ?)?2 1
lgpl-3.0; notice; lgplv3; (?:licensed|released|distributed|available) under(?: the)? lgplv3
lgpl-2.1; notice; lgpl; (?:licensed|released|distributed|available) under(?: the)? lgpl (?:version |v ?)?2 1
gpl-3.0; notice; general; (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? (?:gnu )?general public license (?:version |v ?)?3(?: 0)?
gpl-2.0; notice; general; (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? (?:gnu )?general public license (?:version |v ?)?2(?: 0)?
gpl-3.0; notice; gpl; (?:licensed|released|distributed|available) under(?: the)? (?:gnu )?gpl (?:version |v ?)?3(?: 0)?
gpl-2.0; notice; gpl; (?:licensed|released|distributed|available) under(?: the)? (?:gnu )?gpl (?:version |v ?)?2(?: 0)?
gpl-3.0; notice; gplv3; (?:licensed|released|distributed|available) under(?: the)? (?:gnu )?gplv3
gpl-2.0; notice; gplv2; (?:licensed|released|distributed|available) under(?: the)? (?:gnu )?gplv2
apache-2.0; notice; apache; (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? apache(?: software)? license(?: version | v ?| )2(?: 0)?
apache-1.1; notice; apache; (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? apache(?: software)? license(?: version | v ?| )1 1
mit; notice; mit; (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? mit(?: x11| expat)? license
bsd-3-clause; notice; bsd; (?:licensed|released|distributed|available) under(?: the| a)? (?:3 clause|three clause|new|modified|revised) bsd(?: style)? license
bsd-2-clause; notice; bsd; (?:licensed|released|distributed|available) under(?: the| a)? (?:2 clause|two clause|simplified|freebsd) bsd(?: style)? license
bsd-3-clause; notice; bsd; (?:licensed|released|distributed|available) under(?: the| a)? bsd 3 clause(?: license)?
bsd-2-clause; notice; bsd; (?:licensed|released|distributed|available) under(?: the| a)? bsd 2 clause(?: license)?
bsd; notice; bsd; (?:licensed|released|distributed|available) under(?: the| a)? bsd(?: style)? license
isc; notice; isc; (?:licensed|released|distributed|available) under(?: the)? isc license
mpl-2.0; notice; mozilla; (?:licensed|released|distributed|available) under(?: the)? mozilla public license(?: version | v ?| )2(?: 0)?
mpl-1.1; notice; mozilla; (?:licensed|released|distributed|available) under(?: the)? mozilla public license(?: version | v ?| )1 1
epl-2.0; notice; eclipse; (?:licensed|released|distributed|available) under(?: the)? eclipse public license(?: version | v ?| )2(?: 0)?
epl-1.0; notice; eclipse; (?:licensed|released|distributed|available) under(?: the)? eclipse public license(?: version | v ?| )1(?: 0)?
bsl-1.0; notice; boost; (?:licensed|released|distributed|available) under(?: the)? boost software license(?: version)?(?: 1 0)?
unlicense; notice; unlicense; (?:licensed|released|distributed|available) under(?: the)? unlicense
zlib; notice; zlib; (?:licensed|released|distributed|available) under(?: the)? zlib(?: libpng)? license
cc-by-nc-nd-4.0; notice; nc nd; (?:licensed|released|distributed|available) under(?: a| the)? cc by nc nd 4 0
cc-by-nc-sa-4.0; notice; nc sa; (?:licensed|released|distributed|available) under(?: a| the)? cc by nc sa 4 0
cc-by-nc-4.0; notice; cc nc; (?:licensed|released|distributed|available) under(?: a| the)? cc by nc 4 0
cc-by-nc-3.0; notice; cc nc; (?:licensed|released|distributed|available) under(?: a| the)? cc by nc 3 0
cc-by-nd-4.0; notice; cc nd; (?:licensed|released|distributed|available) under(?: a| the)? cc by nd 4 0
cc-by-sa-4.0; notice; cc sa; (?:licensed|released|distributed|available) under(?: a| the)? cc by sa 4 0
cc-by-sa-3.0; notice; cc sa; (?:licensed|released|distributed|available) under(?: a| the)? cc by sa 3 0
cc-by-4.0; notice; cc by; (?:licensed|released|distributed|available) under(?: a| the)? cc by 4 0
cc-by-3.0; notice; cc by; (?:licensed|released|distributed|available) under(?: a| the)? cc by 3 0
cc0-1.0; notice; cc0; (?:licensed|released|distributed|available|dedicated) (?:under|to)(?: the)? cc0(?: 1 0)?
cc-by-nc-nd-4.0; notice; creative commons; creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-nd-3.0; notice; creative commons; creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? 3 0(?: unported)?(?: license)?
cc-by-nc-sa-4.0; notice; creative commons; creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-sa-3.0; notice; creative commons; creative commons attribution non ?commercial share ?alike 3 0(?: unported)?(?: license)?
cc-by-nc-4.0; notice; creative commons; creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-3.0; notice; creative commons; creative commons attribution non ?commercial 3 0(?: unported)?(?: license)?
cc-by-nd-4.0; notice; creative commons; creative commons attribution no ?derivatives 4 0(?: international)?(?: public)?(?: license)?
cc-by-sa-4.0; notice; creative commons; creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: license)?
cc-by-sa-3.0; notice; creative commons; creative commons attribution share ?alike 3 0(?: unported)?(?: license)?
cc-by-sa-2.0; notice; creative commons; creative commons attribution share ?alike 2 0(?: generic)?(?: license)?
cc-by-4.0; notice; creative commons attribution; creative commons attribution 4 0(?: international)?(?: public)?(?: license)?
cc-by-3.0; notice; creative commons attribution; creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-2.0; notice; creative commons attribution; creative commons attribution 2 0(?: generic)?(?: license)?
cc0-1.0; notice; creative; creative commons(?: cc0)? zero(?: v?1 0)?(?: universal)?
public-domain; notice; public domain; (?:is|are|been|hereby) (?:hereby )?(?:released into|dedicated to|placed in|in) the public domain
proprietary; notice; confidential proprietary; (?:confidential and proprietary|proprietary and confidential)(?: information)?
proprietary; notice; unauthorized; unauthorized (?:copying|use|reproduction)(?: or distribution)? of this (?:file|software|program|material)(?: \S+){0,6} is (?:strictly )?prohibited
agpl-3.0; name; affero; (?:gnu )?affero general public license (?:version |v ?)?3(?: 0)?
agpl-3.0; name; agpl; agpl (?:version |v ?)?3(?: 0)?
agpl-3.0; name; agplv3; agplv3
agpl; name; affero; (?:gnu )?affero general public license
lgpl-3.0; name; lesser; (?:gnu )?lesser general public license(?: lgpl)? (?:version |v ?)?3(?: 0)?
lgpl-2.1; name; lesser; (?:gnu )?lesser general public license(?: lgpl)? (?:version |v ?)?2 1
lgpl-2.0; name; library; (?:gnu )?library general public license(?: lgpl)?(?: version | v ?| )2(?: 0)?
lgpl; name; lesser; (?:gnu )?lesser general public license
lgpl; name; library; gnu library general public license
lgpl-3.0; name; lgplv3; lgplv3
lgpl-2.1; name; lgpl; lgpl (?:version |v ?)?2 1
lgpl-3.0; name; lgpl; lgpl (?:version |v ?)?3(?: 0)?
gpl-3.0; name; gnu general; gnu general public license(?: gpl)? (?:as published by the free software foundation )?(?:version |v ?)?3(?: 0)?
gpl-2.0; name; gnu general; gnu general public license(?: gpl)? (?:as published by the free software foundation )?(?:version |v ?)?2(?: 0)?
gpl-1.0; name; gnu general; gnu general public license(?: gpl)? (?:version |v )1(?: 0)?
gpl-3.0; name; gplv3; (?:gnu )?gplv3
gpl-2.0; name; gplv2; (?:gnu )?gplv2
gpl-3.0; name; gpl; (?:gnu )?gpl (?:version |v ?)?3(?: 0)?
gpl-2.0; name; gpl; (?:gnu )?gpl (?:version |v ?)?2(?: 0)?
gpl; name; gnu general; gnu general public license
gfdl-1.3; name; documentation; gnu free documentation license(?: version | v ?| )1 3
gfdl-1.2; name; documentation; gnu free documentation license(?: version | v ?| )1 2
gfdl; name; documentation; gnu free documentation license
apache-2.0; name; apache; apache(?: software)? license(?: version | v ?| )2(?: 0)?
apache-2.0; name; apache; apache 2 0(?: license)?
apache-1.1; name; apache; apache(?: software)? license(?: version | v ?| )1 1
apache-1.0; name; apache; apache(?: software)? license(?: version | v ?| )1 0
apache; name; apache; apache(?: software)? license
mit-0; name; mit; mit no attribution(?: license)?
mit; name; mit; mit(?: x11| expat)? license
mit; name; expat; expat license
bsd-3-clause; name; bsd; (?:3 clause|three clause|new|modified|revised) bsd(?: license)?
bsd-2-clause; name; bsd; (?:2 clause|two clause|simplified) bsd(?: license)?
bsd-2-clause; name; freebsd; freebsd license
bsd-3-clause; name; bsd; bsd 3 clause(?: license)?
bsd-2-clause; name; bsd; bsd 2 clause(?: license)?
bsd-4-clause; name; bsd; bsd 4 clause(?: license)?
0bsd; name; 0bsd; 0bsd
bsd; name; bsd; bsd license
isc; name; isc; isc license
mpl-2.0; name; mozilla; mozilla public license(?: mpl)?(?: version | v ?| )2(?: 0)?
mpl-1.1; name; mozilla; mozilla public license(?: mpl)?(?: version | v ?| )1 1
mpl; name; mozilla; mozilla public license
epl-2.0; name; eclipse; eclipse public license(?: epl)?(?: version | v ?| )2(?: 0)?
epl-1.0; name; eclipse; eclipse public license(?: epl)?(?: version | v ?| )1(?: 0)?
epl; name; eclipse; eclipse public license
edl-1.0; name; eclipse; eclipse distribution license(?:(?: version | v ?| )1 0)?
cddl-1.1; name; common development; common development and distribution license(?: cddl)?(?: version)? 1 1
cddl; name; common development; common development and distribution license
cpl-1.0; name; common; common public license(?:(?: version | v ?| )1 0)?
ipl-1.0; name; ibm; ibm public license(?: version)?(?: 1 0)?
bsl-1.0; name; boost; boost software license(?: version)?(?: 1 0)?
busl-1.1; name; business; business source license(?: version)?(?: 1 1)?
sspl-1.0; name; server side; server side public license(?: sspl)?(?:(?: version | v ?| )1)?
elastic-2.0; name; elastic; elastic license(?: version)?(?: 2 0)?
commons-clause; name; commons; commons clause(?: license condition)?
unlicense; name; unlicense; (?:the )?unlicense
wtfpl; name; wtfpl; wtfpl
wtfpl; name; want; do what the f\S+ you want to public license
zlib; name; zlib; zlib(?: libpng)? license
libpng; name; libpng; libpng license
cc-by-nc-nd-4.0; name; nc nd; cc by nc nd 4 0
cc-by-nc-nd; name; nc nd; cc by nc nd
cc-by-nc-sa-4.0; name; nc sa; cc by nc sa 4 0
cc-by-nc-sa-3.0; name; nc sa; cc by nc sa 3 0
cc-by-nc-sa; name; nc sa; cc by nc sa
cc-by-nc-4.0; name; cc nc; cc by nc 4 0
cc-by-nc-3.0; name; cc nc; cc by nc 3 0
cc-by-nc-2.0; name; cc nc; cc by nc 2 0
cc-by-nc; name; cc nc; cc by nc
cc-by-nd-4.0; name; cc nd; cc by nd 4 0
cc-by-nd; name; cc nd; cc by nd
cc-by-sa-4.0; name; cc sa; cc by sa 4 0
cc-by-sa-3.0; name; cc sa; cc by sa 3 0
cc-by-sa-2.5; name; cc sa; cc by sa 2 5
cc-by-sa-2.0; name; cc sa; cc by sa 2 0
cc-by-sa; name; cc sa; cc by sa
cc-by-4.0; name; cc by; cc by 4 0
cc-by-3.0; name; cc by; cc by 3 0
cc-by-2.5; name; cc by; cc by 2 5
cc-by-2.0; name; cc by; cc by 2 0
cc0-1.0; name; cc0; cc0(?: 1 0)?(?: universal)?
cc-by-sa; name; creative commons; creative commons attribution share ?alike(?: license)?
cc-by-nc; name; creative commons; creative commons attribution non ?commercial(?: license)?
cc-by; name; creative commons; creative commons attribution(?: license)?
creative-commons; name; creative commons; creative commons licen[cs]e
artistic-2.0; name; artistic; artistic license 2 0
artistic-1.0; name; artistic; artistic license 1 0
artistic; name; artistic; artistic license
psf-2.0; name; python; python software foundation license(?: version)?(?: 2)?
php-3.01; name; php; php license(?:(?: version | v ?| )3 01)?
postgresql; name; postgresql; postgresql license
openssl; name; openssl; openssl license
ncsa; name; ncsa; (?:university of illinois )?ncsa open source license
eupl-1.2; name; european; european union public licen[cs]e(?: eupl)?(?: version | v ?| )1 2
eupl; name; european; european union public licen[cs]e
cecill-b; name; cecill; cecill b(?: license)?
cecill-c; name; cecill; cecill c(?: license)?
cecill; name; cecill; cecill(?: free software)? license
osl-3.0; name; open; open software license(?:(?: version | v ?| )3 0)?
afl-3.0; name; academic; academic free license(?:(?: version | v ?| )3 0)?
ecl-2.0; name; educational; educational community license(?: version)?(?: 2 0)?
ofl-1.1; name; font; (?:sil )?open font license(?: version)?(?: 1 1)?
ms-pl; name; microsoft; microsoft public license(?: ms pl)?
ms-rl; name; microsoft; microsoft reciprocal license(?: ms rl)?
mulan-psl-2.0; name; mulan; mulan permissive software license(?: v| version)? ?2?
upl-1.0; name; universal permissive; universal permissive license(?:(?: version | v ?| )1 0)?
odbl-1.0; name; database; (?:odc )?open database license(?: odbl)?(?: v)?(?: 1 0)?
odc-by-1.0; name; data; open data commons attribution license(?: v)?(?: 1 0)?
pddl-1.0; name; dedication; (?:odc )?public domain dedication and license(?: pddl)?
ogl-uk-3.0; name; government; open government licen[cs]e(?: v| version)? ?3(?: 0)?
ogl; name; government; open government licen[cs]e
cdla-permissive-2.0; name; community data; community data license agreement permissive(?: version)? 2 0
cdla-sharing-1.0; name; community data; community data license agreement sharing(?: version)?(?: 1 0)?
openrail; name; openrail; (?:creativeml |bigscience )?openrail(?: m)?(?: license)?
apsl-2.0; name; apple; apple public source license(?: version)?(?: 2 0)?
vim; name; vim; vim license
x11; name; x11; x11 license
hpnd; name; historical; historical permission notice and disclaimer
proprietary; name; proprietary; proprietary (?:license|software)
proprietary; hint; rights reserved; all rights reserved
public-domain; hint; public domain; public domain
unknown-license; hint; licensed; licensed under(?: the)?(?: terms of)? \S+(?: \S+){0,3} licen[cs]e
unknown-license; hint; license; (?:see|refer to) (?:the )?license(?: file| txt| md)? for (?:details|more information)
unknown-license; hint; license copyright; copyright(?: c)? (?:19|20)\d\d(?: \S+){1,6} (?:see|under) (?:the )?license
"""
