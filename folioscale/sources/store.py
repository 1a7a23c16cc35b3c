"""Opening storage by URI inside tasks."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path for a URI or an absolute path; the scheme names
    that Hadoop uses for S3 are understood. Hadoop's URIs are not quoted: any
    sign in a name stands for itself."""
    place = re.match("([a-z0-9+.-]+:(?://[^/]*)?)(/.*)", re.sub("^s3[an]:", "s3:", uri), re.DOTALL)
    return fs.FileSystem.from_uri(place.group(1) + quote(place.group(2)) if place else uri)
