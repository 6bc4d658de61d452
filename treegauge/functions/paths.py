"""Path arithmetic as Column expressions (POSIX, `/` separated)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def under(path, root) -> Column:
    """`path` is `root` or below it, decided at a separator, never as text."""
    path, root = _col(path), root if isinstance(root, Column) else F.lit(root)
    return (path == root) | F.startswith(
        path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def strictly_under(path, root) -> Column:
    path, root = _col(path), root if isinstance(root, Column) else F.lit(root)
    return F.startswith(path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def under_any(path, roots: list[str]) -> Column:
    """Any of a short list of roots (a parameter) covers `path`."""
    found = F.lit(False)
    for root in roots:
        found = found | under(path, root)
    return found


def basename(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dirname(path) -> Column:
    """`/a/b` -> `/a`, `/a` -> `/`, `a` -> empty."""
    path = _col(path)
    cut = F.length(path) - F.length(basename(path)) - F.lit(1)
    return (F.when(cut > 0, F.substring(path, F.lit(1), cut))
            .when(cut == 0, F.lit("/"))
            .otherwise(F.lit("")))


def suffix(path) -> Column:
    """Last extension with its dot; names made of leading dots have none."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def stem(path) -> Column:
    base = basename(path)
    return F.substring(base, F.lit(1), F.length(base) - F.length(suffix(path)))


def type_of(path) -> Column:
    """File type used for grouping: lower suffix without dot, or `(none)`."""
    found = F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*\.([^.]+)$", 1))
    return F.when(found == "", F.lit("(none)")).otherwise(found)


def relative(path, root) -> Column:
    """`path` seen from `root`; the root itself is `.`."""
    path, root = _col(path), root if isinstance(root, Column) else F.lit(root)
    bare = F.rtrim(root, F.lit("/"))
    return (F.when(path == root, F.lit("."))
            .otherwise(F.substring(path, F.length(bare) + F.lit(2), F.length(path))))


def ancestors(path) -> Column:
    """Directories above an absolute path, shallowest first, without `/`."""
    parts = F.split(_col(path), "/", -1)
    return F.when(
        F.size(parts) > 2,
        F.transform(F.sequence(F.lit(2), F.size(parts) - F.lit(1)),
                    lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
    ).otherwise(F.array().cast("array<string>"))


def self_and_ancestors(path) -> Column:
    return F.concat(ancestors(path), F.array(_col(path)))


def relative_ancestors(rel) -> Column:
    """Proper directory prefixes of a relative path, shallowest first."""
    parts = F.split(_col(rel), "/", -1)
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - F.lit(1)),
                    lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
    ).otherwise(F.array().cast("array<string>"))


def normpath(path) -> Column:
    """Collapse `.`, `..` and doubled separators of an absolute path.

    Most paths are already normal; those skip the fold.
    """
    path = _col(path)
    folded = F.aggregate(
        F.split(path, "/", -1),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part.isin("", "."), kept)
        .when(part == "..",
              F.slice(kept, F.lit(1), F.greatest(F.size(kept) - F.lit(1), F.lit(0))))
        .otherwise(F.concat(kept, F.array(part))))
    needs = F.rlike(path, F.lit(r"//|/\.{1,2}(/|$)|.+/$"))
    return F.when(needs, F.concat(F.lit("/"), F.array_join(folded, "/"))).otherwise(path)


def moved(path, old: str, new: str) -> Column:
    """`path` after its tree moved from `old` to `new`; others unchanged."""
    path = _col(path)
    bare = old.rstrip("/")
    return F.when(F.startswith(path, F.lit(bare + "/")),
                  F.concat(F.lit(new), F.substring(path, F.lit(len(bare) + 1),
                                                   F.length(path)))).otherwise(path)
