"""Licence wordings as templates.

Fixed values: the public texts and notices of the licences. Besides words there is
markup: <<beginOptional>> and <<endOptional>> around what may be missing (regions
nest), <<var;words="a..b">> for a to b words of any kind, <<var;match="x|y">> for
one of several wordings. Letters' case and everything between words don't count.
"""

#: Phrases that name a licence, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WARRANTY = """THIS SOFTWARE IS PROVIDED BY <<var;words="1..20">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words="1..20">> BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>><<var;match="1|a">><<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>><<var;match="2|b">><<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

#: Label and template.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words="1..20">> BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words="1..20">> DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("bsd-2-clause", f"{_REDISTRIBUTION} {_WARRANTY}"),
    ("bsd-3-clause", f"""{_REDISTRIBUTION} <<beginOptional>><<var;match="3|c">><<endOptional>> Neither the name of <<var;words="1..20">> may be used to endorse or promote
products derived from this software without specific prior written permission. {_WARRANTY}"""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will <<var;words="1..20">> be held liable for any damages arising
from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:"""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
<<beginOptional>>You may obtain a copy of the License at <<var;words="1..12">><<endOptional>> Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"""),
    ("apache-2.0", """Apache License <<beginOptional>>Version<<endOptional>> 2.0"""),
    ("gpl-2.0", """GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2"""),
    ("gpl-3.0", """GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"""),
    ("gpl-notice", """<<var;match="This program|This work|This file">> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation<<beginOptional>>, <<var;words="0..3">> version <<var;words="1..3">> of the License
<<beginOptional>>, or (at your option) any later version<<endOptional>><<endOptional>>"""),
    ("lgpl", """GNU <<var;match="Lesser|Library">> General Public License"""),
    ("agpl-3.0", """GNU Affero General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("bsl-1.0", """Distributed under the Boost Software License, Version 1.0<<beginOptional>>. (See accompanying file <<var;words="1..6">> or copy at"""
                """ <<var;words="1..8">>)<<endOptional>>"""),
    ("cc0-1.0", """<<var;match="CC0 1.0|Creative Commons Zero v1.0|Creative Commons CC0">> <<beginOptional>>Universal<<endOptional>>"""),
    *((f"cc-{kind}-{version}", f"""CC {kind} {version}""") for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for version in ("2.0", "3.0", "4.0")),
    *((f"cc-{kind}-4.0", f"""Creative Commons {name} 4.0""") for kind, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"),
       ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))),
    *((label, f"""SPDX-License-Identifier: {name}""") for label, name in (("mit", "MIT"), ("isc", "ISC"), ("apache-2.0", "Apache-2.0"), ("bsd-2-clause", "BSD-2-Clause"),
       ("bsd-3-clause", "BSD-3-Clause"), ("gpl-2.0", "GPL-2.0"), ("gpl-3.0", "GPL-3.0"), ("mpl-2.0", "MPL-2.0"))),
]
