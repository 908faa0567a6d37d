"""Entry paths as column expressions. Text in, text out; names that are no UTF-8 go through :func:`byte_text`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display(raw: Column) -> Column:
    """Readable form of a raw name: bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def byte_text(raw: Column) -> Column:
    """A text with one character for each byte: nothing is lost, and text functions work on it."""
    return F.decode(raw, "ISO-8859-1")


def utf16_text(raw: Column) -> Column:
    """UTF-16LE names; null for an odd number of bytes or lone surrogates."""
    text = F.decode(raw, "UTF-16LE")
    return F.when((F.length(raw) % 2 == 0) & (F.encode(text, "UTF-16LE") == raw), text)


def components(path: Column) -> Column:
    """Path components without empty ones and ``.``."""
    return F.filter(F.split(path, "/", -1), lambda c: (c != "") & (c != "."))


def sanitise(path: Column) -> Column:
    """The safe relative path, or null: absolute, with NUL, with ``..``, or nothing left."""
    parts = components(path)
    bad = F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\0")) | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def create_name(path: Column) -> Column:
    """Name under which a file is stored: root and ``.`` stripped; null with ``..`` or when nothing is left."""
    parts = components(path)
    return F.when(~F.array_contains(parts, "..") & (F.size(parts) > 0), F.array_join(parts, "/"))


def nesting(path: Column, both: bool = True) -> Column:
    """Number of components, ``.`` and empty ones left out; extraction splits on both slashes, creation on ``/`` only."""
    return F.size(F.filter(F.split(path, r"[/\\]" if both else "/", -1), lambda c: (c != "") & (c != ".")))


def create_error(name: Column, path_bytes: int | None = 64 << 10, most_nesting: int | None = 64) -> Column:
    """Why no entry may be made under a name (``unsafe``, ``path_bytes``, ``nesting``), or null; ``.`` and ``./`` may."""
    out = F.when(~name.isin(".", "./") & sanitise(name).isNull(), "unsafe")
    if path_bytes is not None:
        out = out.when(F.octet_length(name) > path_bytes, "path_bytes")
    if most_nesting is not None:
        out = out.when(nesting(name, both=False) > most_nesting, "nesting")
    return out


def without_slash(path: Column) -> Column:
    """One trailing slash left out."""
    return F.when(F.endswith(path, F.lit("/")), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)


def leaf(path: Column) -> Column:
    return F.substring_index(without_slash(path), "/", -1)


def parent(path: Column) -> Column:
    trimmed = without_slash(path)
    return F.when(F.contains(trimmed, F.lit("/")), F.regexp_replace(trimmed, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(path: Column, itself: bool = True) -> Column:
    """The path's prefixes that end before a slash, shortest first, the path itself last or left out.

    What is below a directory is found by an equality join on these, not by a prefix comparison.
    """
    parts = F.split(path, "/", -1)
    last = F.size(parts) if itself else F.size(parts) - 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def is_root_nuspec(path: Column) -> Column:
    return path.rlike(r"^[^/]*\.nuspec$")


def is_meta_inf_child(path: Column) -> Column:
    return path.rlike(r"^META-INF/[^/]+$")


def is_ipa_info_plist(path: Column) -> Column:
    """``Payload/<one component>.app/Info.plist``; the first ``.app/`` ends the bundle's name."""
    return path.rlike(r"^Payload/(?:(?!\.app/)[^/])+\.app/Info\.plist$")
