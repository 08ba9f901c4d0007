"""License wording as template markup.

``<<beginOptional>>`` ... ``<<endOptional>>`` may be left out, nested too.
``<<var;name=N;words=A,B>>`` stands for A to B words of any kind;
``<<var;name=N;match=X|Y Z>>`` for one of the phrases.  All else is mandatory.
"""

# The wording of public licenses and of the notices that point to them.
_COPYRIGHT = "<<beginOptional>>Copyright <<var;name=holder;words=0,24>><<endOptional>>"
_AS_IS = ("IS PROVIDED <<beginOptional>>BY THE <<var;name=party;words=1,12>><<endOptional>> AS IS AND "
          "ANY EXPRESS OR IMPLIED WARRANTIES INCLUDING BUT NOT LIMITED TO THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
          "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED")
_SOURCE = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met: <<beginOptional>><<var;name=bullet;words=1,1>><<endOptional>> Redistributions of source code "
           "must retain the above copyright notice, this list of conditions and the following disclaimer. "
           "<<beginOptional>><<var;name=bullet;words=1,1>><<endOptional>> Redistributions in binary form must reproduce the above "
           "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
           "provided with the distribution. ")
_GNU_NOTICE = ("is free software<<var;name=mark;words=0,1>> you can redistribute it and/or modify it under the terms of the GNU "
               "<<var;name=kind;match={kind}>> as published by the Free Software Foundation, "
               "<<var;name=which;match=either version|version>> {version} of the License")

TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
            "notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in "
            "all copies or substantial portions of the Software. "
            "<<beginOptional>>THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND<<endOptional>>"),
    ("mit", "<<var;name=verb;match=released|licensed|distributed|available|licenced|covered|published>> under "
            "<<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>> MIT "
            "<<var;name=noun;match=license|licence>>"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-2-clause", _COPYRIGHT + " <<beginOptional>>All rights reserved.<<endOptional>> " + _SOURCE +
     "THIS SOFTWARE " + _AS_IS),
    ("bsd-3-clause", _COPYRIGHT + " <<beginOptional>>All rights reserved.<<endOptional>> " + _SOURCE +
     "<<beginOptional>><<var;name=bullet;words=1,1>><<endOptional>> Neither the name of <<var;name=party;words=1,16>> nor the names of "
     "its contributors may be used to endorse or promote products derived from this software without specific prior written "
     "permission. THIS SOFTWARE " + _AS_IS),
    ("apache-2.0", "<<var;name=verb;match=licensed|released|distributed|available>> under <<beginOptional>>the terms of"
                   "<<endOptional>> the Apache <<var;name=noun;match=license|licence>> "
                   "<<var;name=version;match=version 2 0|2 0|v2 0|v2|version 2>> "
                   "<<beginOptional>>(the \"License\"); you may not use this <<var;name=what;match=file|work|software>> except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0<<endOptional>>"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-3.0", "licensed under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License "
                "<<var;name=version;match=version 3|v3|version 3 0|3>>"),
    ("gpl-2.0", "licensed under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License "
                "<<var;name=version;match=version 2|v2|version 2 0|2>>"),
    ("gpl-3.0", _GNU_NOTICE.format(kind="General Public License", version="3")),
    ("gpl-2.0", _GNU_NOTICE.format(kind="General Public License", version="2")),
    ("lgpl-2.1", _GNU_NOTICE.format(kind="Lesser General Public License|Library General Public License", version="2.1")),
    ("lgpl-3.0", _GNU_NOTICE.format(kind="Lesser General Public License", version="3")),
    ("agpl-3.0", _GNU_NOTICE.format(kind="Affero General Public License", version="3")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. <<beginOptional>>If a copy of "
                "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.<<endOptional>>"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the "
             "<<var;name=party;match=author|authors>> be held liable for any damages arising from the use of this software. "
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
             "alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software"),
    *[(f"cc-{code}-{major}.{minor}",
       f"<<var;name=verb;match=licensed|released|available|distributed|published>> under <<beginOptional>>a<<endOptional>> "
       f"<<beginOptional>>the<<endOptional>> <<var;name=name;match=CC {code}|Creative Commons {long}>> "
       f"<<beginOptional>>license<<endOptional>> <<beginOptional>>version<<endOptional>> {major}.{minor}")
      for code, long in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"),
                         ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
                         ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
      for major, minor in ((3, 0), (4, 0))],
]
