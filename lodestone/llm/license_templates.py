"""The wording of public licence notices, in words as ``license_scan.words`` gives them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """A base phrase counts wherever it stands whole; any other template counts from its share of k-grams.

    ``must`` is the part of the wording that tells it from others, and has to stand unbroken.
    """

    label: str
    text: str
    base: bool = False
    must: str = ""


BASE = [
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
]

NOTICES = [
    Template("all-rights-reserved", "all rights reserved"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("apache-2", "licensed under the apache license version 2 0 the license", must="apache license version 2 0"),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    Template("bsd-3", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("gpl-3", "licensed under the gnu general public license version 3", must="gnu general public license version 3"),
    Template("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", must="gnu general public license as published by the free software foundation either version 3 of the license"),
    Template("gpl-2", "licensed under the gnu general public license version 2", must="gnu general public license version 2"),
    Template("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", must="gnu general public license as published by the free software foundation either version 2 of the license"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", must="gnu general public license"),
    Template("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", must="gnu lesser general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", must="gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", must="gnu affero general public license"),
    Template("agpl", "licensed under the gnu affero general public license", must="gnu affero general public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", must="mozilla public license v 2 0"),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", must="eclipse public license 2 0"),
    Template("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", must="eclipse public license v1 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    Template("boost", "distributed under the boost software license version 1 0", must="boost software license version 1 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc0", "has waived all copyright and related or neighboring rights to this work"),
    Template("cc0", "licensed under cc0 1 0 universal", must="cc0 1 0 universal"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", must="attribution 4 0"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", must="attribution sharealike 4 0"),
    Template("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", must="attribution noderivatives 4 0"),
    Template("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", must="attribution noncommercial sharealike 4 0"),
    Template("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", must="attribution noncommercial noderivatives 4 0"),
    Template("ofl", "this font software is licensed under the sil open font license version 1 1", must="sil open font license"),
    Template("artistic-2", "licensed under the artistic license 2 0", must="artistic license 2 0"),
    Template("wtfpl", "do what the fuck you want to public license"),
]


def must_hold(t: Template, k: int) -> list[int]:
    """Positions of the k-grams of ``must``."""
    w, m = t.text.split(), t.must.split()
    start = next(i for i in range(len(w) - len(m) + 1) if w[i : i + len(m)] == m)
    return list(range(start, start + len(m) - k + 1))
