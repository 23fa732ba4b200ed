"""Notices of public licenses: texts, standard headers, short sentences, names and identifiers (fixed values).

``NAMES`` holds, for each template, phrases that a notice has to hold as they are, because they alone tell the license
and its version; ``SPELLINGS`` the names that stand for a license behind words like "under the".  A template's name
up to ``~`` is what is reported.
"""

from __future__ import annotations

WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
            "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
            "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
         "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
         "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
         "furnished to do so")
MIT = (f"{GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be "
       "included in all copies or substantial portions of the Software.")
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
       "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
       "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
       "documentation and/or other materials provided with the distribution.")
BSD_WARRANTY = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
                "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
                "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
                "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
                "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
                "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
                "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
                "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
                "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
GNU = {"gpl": "GNU General Public License", "lgpl": "GNU Lesser General Public License", "agpl": "GNU Affero General Public License"}


def gnu_header(name: str, version: str) -> str:
    what = "This library" if name == "lgpl" else "This program"
    return (f"{what} is free software: you can redistribute it and/or modify it under the terms of the {GNU[name]} as "
            f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")


TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                         "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                         "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                         "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": gnu_header("gpl", "3"),
    "mit": "Released under the MIT License.",
    "mit-text": MIT,
    "mit-full": f"{MIT} {WARRANTY}",
    "mit-0-text": f"{GRANT}. {WARRANTY}",
    "bsd": "Released under the BSD License.",
    "bsd-2-clause-text": f"{BSD} {BSD_WARRANTY}",
    "bsd-3-clause-text": f"{BSD} Neither the name of the copyright holder nor the names of its contributors {ENDORSE} {BSD_WARRANTY}",
    "bsd-3-clause-text~author": f"{BSD} The name of the author may not be used to endorse or promote products derived from this software without specific "
                                f"prior written permission. {BSD_WARRANTY}",
    "bsd-4-clause-text": f"{BSD} All advertising materials mentioning features or use of this software must display the following acknowledgement: This "
                         f"product includes software developed by the organization. Neither the name of the copyright holder nor the names of its "
                         f"contributors {ENDORSE} {BSD_WARRANTY}",
    "isc-text": f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_WARRANTY}",
    "0bsd-text": f"{ISC_GRANT}. {ISC_WARRANTY}",
    "gpl-2.0-header": gnu_header("gpl", "2"),
    "lgpl-2.1-header": gnu_header("lgpl", "2.1"),
    "lgpl-3.0-header": gnu_header("lgpl", "3"),
    "agpl-3.0-header": gnu_header("agpl", "3"),
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                      "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
                      "available at http://www.eclipse.org/legal/epl-2.0.",
    "bsl-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                      "http://www.boost.org/LICENSE_1_0.txt)",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
                 "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
                 "applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must "
                 "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
                 "acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked "
                 "as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source "
                 "distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                      "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                      "non-commercial, and by any means.",
}

NAMES = {
    "apache-2.0": ["the Apache License Version 2.0"],
    "apache-2.0-header": ["the Apache License Version 2.0"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0"],
    "gpl-3.0": ["the GNU General Public License version 3"],
    "mit": ["the MIT License"],
    "mit-text": ["to deal in the Software", "the above copyright notice and this permission notice"],
    "mit-full": ["to deal in the Software", "the above copyright notice and this permission notice", "noninfringement"],
    "mit-0-text": ["to deal in the Software", "furnished to do so the software is provided"],
    "bsd": ["under the BSD License"],
    "bsd-2-clause-text": ["distribution this software is provided"],
    "bsd-3-clause-text": ["distribution neither the name", "endorse or promote products"],
    "bsd-3-clause-text~author": ["distribution the name", "endorse or promote products"],
    "bsd-4-clause-text": ["advertising materials mentioning features", "endorse or promote products"],
    "isc-text": ["with or without fee", "provided that the above copyright notice"],
    "0bsd-text": ["with or without fee", "hereby granted the software is provided"],
    **{f"{n}-{v}-header": [f"the {GNU[n]} as published", f"version {v.removesuffix('.0')} of the"]
       for n, v in (("gpl", "2.0"), ("gpl", "3.0"), ("lgpl", "2.1"), ("lgpl", "3.0"), ("agpl", "3.0"))},
    "mpl-2.0-header": ["Mozilla Public License v. 2.0"],
    "epl-2.0-header": ["Eclipse Public License 2.0"],
    "bsl-1.0-header": ["Boost Software License Version 1.0"],
    "zlib-text": ["misrepresented you must not claim"],
    "unlicense-text": ["free and unencumbered software"],
}

#: Words before the name of a license; the last word comes right before it.
LEADS = ["under", "under a", "under an", "under the", "under terms of the", "under the terms of", "under the terms of the", "under the terms and conditions of the",
         "subject to the terms of the", "governed by the"]
SPDX = "SPDX-License-Identifier"

SPELLINGS: dict[str, str] = {}
IDENTIFIERS: dict[str, str] = {}
#: Names without a version, which count where none with a version is found.
OPEN = {"gpl", "lgpl", "agpl", "mpl", "epl", "apache", "bsd"}


def _spell(license: str, *names: str) -> None:
    for n in names:
        SPELLINGS[n] = license
        if n.split()[-1].lower() not in ("license", "licence"):
            SPELLINGS[f"{n} License"] = license


def _versions(label: str, short: str, *names: str, versions: tuple[str, ...]) -> None:
    whole = [*names, short] if short else list(names)
    both = [*whole, *(f"{n} {short}" for n in names if short)]
    if label in OPEN:
        _spell(label, *(b for b in both))
    for v in versions:
        for form in dict.fromkeys((v, v.removesuffix(".0"))):
            for b in both:
                _spell(f"{label}-{v}", f"{b} {form}", f"{b} v{form}", f"{b} v {form}", f"{b} version {form}", f"{b}-{form}", f"version {form} of the {b}")
            if short:
                _spell(f"{label}-{v}", f"{short}v{form}", f"{short}{form}")
        for tail in ("", "-only", "-or-later"):
            IDENTIFIERS[f"{label}-{v}{tail}"] = f"{label}-{v}"
            _spell(f"{label}-{v}", f"{label}-{v}{tail}")


_versions("gpl", "GPL", "GNU General Public License", "GNU GPL", "GNU Public License", "General Public License", versions=("1.0", "2.0", "3.0"))
_versions("lgpl", "LGPL", "GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "Lesser General Public License",
          versions=("2.0", "2.1", "3.0"))
_versions("agpl", "AGPL", "GNU Affero General Public License", "GNU AGPL", "Affero General Public License", versions=("3.0",))
_versions("mpl", "MPL", "Mozilla Public License", versions=("1.0", "1.1", "2.0"))
_versions("epl", "EPL", "Eclipse Public License", versions=("1.0", "2.0"))
_versions("apache", "", "Apache License", "Apache Software License", "Apache Public License", versions=("1.0", "1.1", "2.0"))
_spell("apache-2.0", "Apache 2.0", "Apache 2", "Apache v2", "Apache v2.0", "Apache-2.0", "Apache version 2.0")
_versions("bsl", "", "Boost Software License", versions=("1.0",))
_versions("artistic", "", "Artistic License", "Perl Artistic License", versions=("1.0", "2.0"))
_versions("eupl", "EUPL", "European Union Public License", "European Union Public Licence", versions=("1.1", "1.2"))
for _short, _long in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
                      ("by-nd", "Attribution-NoDerivs"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
                      ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivs")):
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _name = f"cc-{_short}-{_v}"
        IDENTIFIERS[_name] = _name
        _wide = _long.replace("Share", "Share ").replace("Non", "Non-")
        for _l in {_long, _long.replace("-", " "), _long.replace("-", " - "), _wide, _wide.replace("-", " "), _long.replace("ShareAlike", "Share-Alike")}:
            for _end in (_v, f"{_v} International", f"{_v} Unported", f"{_v} Generic"):
                _spell(_name, f"Creative Commons {_l} {_end}", f"CC {_l} {_end}")
        for _kind in {_short, _short.replace("-", " ")}:
            _spell(_name, f"CC {_kind} {_v}", f"CC-{_kind} {_v}", f"CC {_kind}-{_v}", f"CC-{_kind}-{_v}", f"Creative Commons {_kind} {_v}")
_spell("cc0-1.0", "CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero", "Creative Commons CC0", "Creative Commons CC0 1.0 Universal")
_spell("mit", "MIT License", "MIT/X11", "MIT/Expat", "Expat License")
_spell("mit-0", "MIT-0", "MIT No Attribution")
_spell("isc", "ISC License")
_spell("bsd", "BSD License", "BSD-style License")
_spell("0bsd", "0BSD", "Zero-Clause BSD", "BSD Zero Clause")
for _n, _words, _other in (("2", "two", ["Simplified", "FreeBSD"]), ("3", "three", ["New", "Modified", "Revised"]), ("4", "four", ["Original", "Old"])):
    _spell(f"bsd-{_n}-clause", f"BSD {_n}-Clause", f"BSD-{_n}-Clause", f"{_n}-Clause BSD", f"BSD {_n} Clause", f"{_n} Clause BSD", f"{_words}-clause BSD",
           f"BSD {_words}-clause", f"{_words} clause BSD", f"BSD ({_n}-clause)", *(f"{o} BSD License" if o != "FreeBSD" else "FreeBSD License" for o in _other))
_spell("zlib", "zlib License", "zlib/libpng License")
_spell("unlicense", "Unlicense", "The Unlicense")
_spell("wtfpl", "WTFPL", "Do What The Fuck You Want To Public License")
for _n in ("mit", "mit-0", "isc", "0bsd", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "zlib", "unlicense", "wtfpl", "cc0-1.0"):
    IDENTIFIERS[_n] = _n
