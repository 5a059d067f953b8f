"""Addresses of a page's images and other resources."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, urljoin, urlsplit

# How a candidate's size is written, embedded images that are kept, attributes of images that load late, image types that any browser shows, and where other resources are fetched.
SIZE = re.compile(r"\d+w|(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?x", re.A)
EMBEDDED = re.compile(r"data:image/(?:png|jpeg|gif|webp|avif);base64,[a-z0-9+/=\s]+", re.I)
LATE_SETS, LATE = ("data-srcset", "data-lazy-srcset"), ("data-src", "data-lazy-src", "data-original")
SHOWN = re.compile(r"image/(?:png|jpeg|gif|webp|avif)", re.I)
PROXY = "/api/image?asset=1&url="


def candidates(srcset: str) -> Iterator[tuple[str, str]]:
    """(address, size as written) of each candidate; an address ends at white space, its size at a comma."""
    at, end = 0, len(srcset)
    while at < end:
        if srcset[at].isspace():
            at += 1
            continue
        stop = at
        while stop < end and not srcset[stop].isspace():
            stop += 1
        address, at, size = srcset[at:stop], stop, ""
        if not address.endswith(","):
            comma = srcset.find(",", at)
            size, at = (srcset[at:].strip(), end) if comma < 0 else (srcset[at:comma].strip(), comma + 1)
        yield address.rstrip(","), size


def best_candidate(srcset: str | None, fallback: str | None = None, widest: int = 960) -> str | None:
    """The candidate nearest to the wanted width, or density 1, from below, else the smallest above; the first of equals.

    The image's own address stands for density 1 where no candidate has a width or that density.
    """
    scored, usual = [], False
    for k, (address, written) in enumerate(candidates(srcset or "")):
        if not address or (written and not SIZE.fullmatch(written)):
            continue
        size, wide = float(written[:-1]) if written else 1.0, written.endswith("w")
        if not 0 < size < float("inf"):
            continue
        usual = usual or wide or size == 1
        share = size / (widest if wide else 1)
        scored.append((share if share <= 1 else -share, -k, address))
    if fallback and not usual and (srcset or "").strip():
        return fallback
    return max(scored)[2] if scored else None


def _embedded(address: str | None) -> bool:
    return (address or "").lower().startswith("data:")


def responsive(attributes: dict[str, str | None], image: bool) -> str | None:
    """The best candidate of an element's sets: the active one unless it is embedded, then late ones."""
    width = (attributes.get("width") or "").strip()
    widest = min(1280, max(960, float(width))) if re.fullmatch(r"\d+(?:\.\d+)?", width) else 960
    own = attributes.get("src") if image else None
    fallback = own if own and not _embedded(own) else None
    active = best_candidate(attributes.get("srcset"), fallback, widest)
    if active and not _embedded(active):
        return active
    return next((found for k in LATE_SETS if (found := best_candidate(attributes.get(k), fallback, widest))), active)


def usable_source(attributes: dict[str, str | None]) -> bool:
    """Whether a picture's source applies whatever the browser: no media but all, and a type that all show."""
    media, kind = (attributes.get("media") or "").strip().lower(), (attributes.get("type") or "").strip()
    return media in ("", "all") and (not kind or bool(SHOWN.fullmatch(kind)))


def image_source(attributes: dict[str, str | None], picture: str | None = None) -> str | None:
    """An image's address: its picture's source, its sets, its own unless embedded, then late ones."""
    found = picture or responsive(attributes, True)
    if found:
        return found
    own = attributes.get("src")
    return own if own and not _embedded(own) else next((attributes[k] for k in LATE if attributes.get(k)), own)


def resource_url(value: str, base: str) -> str:
    """A resource's address for a page that is shown elsewhere: fragments and embedded images as they are, public ones through the proxy, others empty."""
    if value.startswith("#") or EMBEDDED.fullmatch(value):
        return value
    try:
        url = urljoin(base, value.strip())
        parts = urlsplit(url)
    except ValueError:
        return ""
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username or parts.password:
        return ""
    return PROXY + quote(url, safe="!'()*-._~")
