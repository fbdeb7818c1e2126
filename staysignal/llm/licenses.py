"""Fixed values of the licence scan: standard source headers, titles and declarations, whole licence
texts (``license_texts``) and SPDX identifiers."""

from __future__ import annotations

from pathlib import Path

_GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General "
        "Public License as published by the Free Software Foundation, either version {} of the License, or (at your "
        "option) any later version.")
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
_CC_KINDS = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial",
             "CC-BY-ND-4.0": "Attribution-NoDerivatives", "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike",
             "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives"}

HEADERS = [
    ("GPL-2.0", _GPL.format("", "2")),
    ("GPL-3.0", _GPL.format("", "3")),
    ("LGPL-2.1", _GPL.format("Lesser ", "2.1").replace("program", "library")),
    ("LGPL-3.0", _GPL.format("Lesser ", "3").replace("program", "library")),
    ("AGPL-3.0", _GPL.format("Affero ", "3")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See "
                   "the NOTICE file distributed with this work for additional information regarding copyright ownership. "
                   "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not "
                   "use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work."),
    *[(name, _CC.format(kind)) for name, kind in _CC_KINDS.items()],
    *[(name, f"Creative Commons {kind} 4.0 International Public License") for name, kind in _CC_KINDS.items()],
]

SPDX = sorted({name for name, _ in HEADERS} | {
    "MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "EPL-1.0", "GPL-1.0", "LGPL-2.0", "MPL-1.1", "Apache-1.1",
    "Artistic-2.0", "PostgreSQL", "X11", "NCSA", "OpenSSL", "curl", "Libpng", "Ruby", "PSF-2.0", "Python-2.0", "WTFPL", "Vim"})


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of the licence files."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
