"""Codec names (F9): classes of names that mean the same codec."""

from __future__ import annotations

import codecs
import encodings
import encodings.aliases
import pkgutil
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamfix.functions.text import codec_key


def codec_classes() -> dict[str, str]:
    """Canonical key of each name in the standard alias registry -> name of its codec.

    Names are one class when the registry leads them to one codec, directly or by other
    names; names of no codec on this platform are left out."""
    names = set(encodings.aliases.aliases) | set(encodings.aliases.aliases.values()) | {m.name for m in pkgutil.iter_modules(encodings.__path__)}
    out = {}
    for name in sorted(names):
        try:
            out[re.sub("[^a-z0-9]", "", name.lower())] = codecs.lookup(name).name
        except LookupError:
            continue
    return out


def codec_class(x) -> Column:
    """The codec that a name stands for, whatever its case, signs or alias; null if unknown."""
    table = F.create_map(*[F.lit(v) for pair in codec_classes().items() for v in pair])
    return F.try_element_at(table, codec_key(x))


def same_codec(a, b) -> Column:
    """Whether two names stand for one codec (false if either is unknown)."""
    return F.coalesce(codec_class(a) == codec_class(b), F.lit(False))
