"""Licence names and the notices, headers, identifiers and full texts that announce them."""

from __future__ import annotations

from importlib import resources

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
)
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_APACHE_REST = 'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."

#: What a sentence says that both licences share.
_EITHER_BSD = "BSD-2-Clause OR BSD-3-Clause"

#: The notices that were here first; their places are kept.
_FIRST = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    (_EITHER_BSD, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    (_EITHER_BSD, "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", _MPL),
)

_TEXTS = (
    *(("MIT", text) for text in (*_MIT, _AS_IS, " ".join(_MIT), " ".join((*_MIT, _AS_IS)), "The MIT License (MIT) Copyright (c) " + " ".join((*_MIT, _AS_IS)))),
    *(("BSD-2-Clause", f"{head} {_BSD} {_BSD_TWO} {_BSD_AS_IS}") for head in ("", "BSD 2-Clause License Copyright (c) All rights reserved.")),
    *(("BSD-3-Clause", f"{head} {_BSD} {_BSD_TWO} {_BSD_THIRD} {_BSD_AS_IS}") for head in ("", "BSD 3-Clause License Copyright (c) All rights reserved.")),
    ("BSD-3-Clause", _BSD_THIRD),
    *(("ISC", text) for text in (_ISC + _ISC_KEEP, f"ISC License Copyright (c) {_ISC}{_ISC_KEEP} {_ISC_AS_IS}", f"{_ISC}{_ISC_KEEP} {_ISC_AS_IS}")),
    *(("0BSD", text) for text in (_ISC + ".", f"{_ISC}. {_ISC_AS_IS}")),
    *(("Apache-2.0", text) for text in (f"{_APACHE} {_APACHE_REST}", f"Copyright {_APACHE} {_APACHE_REST}", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/")),
    *(("MPL-2.0", text) for text in (f"{_MPL} If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. For more information, please refer to http://unlicense.org/"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
)

#: GNU licences: name, title, version, date of the text's head.
_GNU = (
    ("GPL-2.0", "General Public License", "2", "June 1991"), ("GPL-3.0", "General Public License", "3", "29 June 2007"), ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"), ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"), ("GFDL-1.3", "Free Documentation License", "1.3", "3 November 2008"),
)
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
#: Name and usual title of the others.
_TITLES = (
    ("0BSD", "Zero-Clause BSD License"), ("Apache-2.0", "Apache License 2.0"), ("Artistic-2.0", "Artistic License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSL-1.0", "Boost Software License 1.0"),
    ("CDDL-1.0", "Common Development and Distribution License 1.0"), ("EPL-1.0", "Eclipse Public License 1.0"), ("EPL-2.0", "Eclipse Public License 2.0"), ("EUPL-1.2", "European Union Public Licence 1.2"), ("ISC", "ISC License"), ("MIT", "MIT License"),
    ("MIT-0", "MIT No Attribution License"), ("MPL-1.1", "Mozilla Public License 1.1"), ("MPL-2.0", "Mozilla Public License 2.0"), ("MS-PL", "Microsoft Public License"), ("NCSA", "University of Illinois NCSA Open Source License"), ("OFL-1.1", "SIL Open Font License 1.1"),
    ("PostgreSQL", "PostgreSQL License"), ("PSF-2.0", "Python Software Foundation License 2.0"), ("Unlicense", "Unlicense"), ("WTFPL", "WTFPL License"), ("X11", "X11 License"), ("Zlib", "zlib License"), ("curl", "curl License"),
)


def _spdx(*names: str) -> list[str]:
    return [f"SPDX-License-Identifier: {name}" for name in names]


def _gnu(name: str, title: str, version: str, date: str) -> list[str]:
    later = f"either version {version} of the License, or (at your option) any later version."
    subject = "library" if name.startswith("LGPL") else "program"
    grant = f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation"
    return [
        f"GNU {title.upper()} Version {version}, {date}", f"GNU {title} version {version}", f"GNU {title} v{version}", f"GNU {title} v{version}.0", f"Licensed under the GNU {title} version {version}.", f"Released under the GNU {title}, version {version}.",
        f"This work is licensed under the GNU {title}, version {version}.", f"Licensed under the {name} license.", f"{grant}, {later}", f"{grant}, version {version} of the License.",
        f"{grant}, {later} This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title} for more details. You should have received a copy of the GNU {title} along with this {subject}. If not, see http://www.gnu.org/licenses/.",
        *_spdx(name, f"{name}-only", f"{name}-or-later"),
    ]


def _cc(code: str, title: str, version: str) -> list[str]:
    kind = "International" if version == "4.0" else "Unported"
    return [
        f"Licensed under CC {code} {version}.", f"Released under CC {code} {version}.", f"License: CC {code} {version}", f"Creative Commons {title} {version} {kind}", f"This work is licensed under CC {code} {version}.", f"Licensed under a Creative Commons {title} {version} {kind} License.", f"This work is licensed under a Creative Commons {title} {version} {kind} License.",
        f"Creative Commons {title} {version} {kind} Public License", f"This work is licensed under the Creative Commons {title} {version} {kind} License. To view a copy of this license, visit http://creativecommons.org/licenses/{code.lower()}/{version}/.", *_spdx(f"CC-{code}-{version}"),
    ]


def _titled(name: str, title: str) -> list[str]:
    return [f"The {title}", f"Licensed under the {title}.", f"Released under the {title}.", f"This project is licensed under the {title}.", f"This work is licensed under the {title}.", f"This project is licensed under the {title} - see the LICENSE file for details.", f"License: {name}", *_spdx(name)]


def _full_texts() -> list[tuple[str, str]]:
    """Whole licence texts, under their file's name; GNU names have a '.0' for whole versions."""
    files = sorted((f for f in resources.files("docframe.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return [(f.name[:-4] + (".0" if f.name[:-4].count(".") == 0 else ""), f.read_text(encoding="utf-8")) for f in files]


def _all() -> tuple[tuple[str, str], ...]:
    found = [*_FIRST, *_TEXTS, *_full_texts()]
    found += [(row[0], text) for row in _GNU for text in _gnu(*row)]
    found += [(f"CC-{code}-{version}", text) for code, title in _CC for version in ("4.0", "3.0") for text in _cc(code, title, version)]
    found += [(name, text) for name, title in _TITLES for text in _titled(name, title)]
    found += [("CC0-1.0", text) for text in ("Licensed under CC0 1.0.", "Released under CC0 1.0.", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero 1.0 Universal License", "Released under the CC0 1.0 Universal public domain license.", *_spdx("CC0-1.0"))]
    # an apostrophe is no part of a word, and SQL text needs none
    return tuple(dict.fromkeys((name, text.replace("'", " ").strip()) for name, text in found))


TEMPLATES = _all()
