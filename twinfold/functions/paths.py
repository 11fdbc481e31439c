"""Path algebra as column expressions.

A path is clean and relative; a directory ends in ``/`` and the root is ``.``.
Everything here is built from built-in functions, so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "."
#: Directories that are kept or removed whole (fixed values).
ATOMS = (".git", ".svn")
_ATOM = r"^((?:[^/]+/)*?(?:\.git|\.svn)/)"


def _c(p: Column | str) -> Column:
    return F.col(p) if isinstance(p, str) else p


def is_dir(p: Column | str) -> Column:
    p = _c(p)
    return (p == ROOT) | p.endswith("/")


def is_file(p: Column | str) -> Column:
    p = _c(p)
    return (p != "") & ~is_dir(p)


def parts(p: Column | str) -> Column:
    """The names on the path, root first; none for the root."""
    p = _c(p)
    return F.when(p == ROOT, F.array().cast("array<string>")).otherwise(F.split(F.rtrim(p, F.lit("/")), "/"))


def parent(p: Column | str) -> Column:
    """The directory that holds the path, with its ``/``, or the root."""
    up = F.regexp_extract(_c(p), "^(.*/)[^/]+/?$", 1)
    return F.when(up == "", ROOT).otherwise(up)


def base(p: Column | str) -> Column:
    """The last name, without ``/``."""
    return F.substring_index(F.rtrim(_c(p), F.lit("/")), "/", -1)


def _joined(names: Column, upto: Column) -> Column:
    # sequence(1, 0) counts down, hence the guard.
    every = F.transform(F.sequence(F.lit(1), upto), lambda i: F.concat(F.array_join(F.slice(names, F.lit(1), i), "/"), F.lit("/")))
    return F.when(upto > 0, every).otherwise(F.array().cast("array<string>"))


def ancestors(p: Column | str) -> Column:
    """Every directory that holds the path, root first, a directory itself included."""
    p = _c(p)
    n = F.size(parts(p)) - F.when(is_dir(p), 0).otherwise(1)
    return F.concat(F.array(F.lit(ROOT)), _joined(parts(p), n))


def proper_ancestors(p: Column | str) -> Column:
    """The ancestors without the path itself."""
    p = _c(p)
    return F.when(p == ROOT, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit(ROOT)), _joined(parts(p), F.size(parts(p)) - 1)))


def steps(p: Column | str, skip: Column | str | None = None) -> Column:
    """The prefixes of the path below the root, the path last; with skip, those after it if it is one of them."""
    p = _c(p)
    all_steps = F.filter(F.array_distinct(F.concat(ancestors(p), F.array(p))), lambda x: (x != ROOT) & (x != ""))
    if skip is None:
        return all_steps
    at = F.array_position(all_steps, _c(skip) if not isinstance(skip, str) else F.lit(skip))
    is_step = (at > 0) & is_dir(_c(skip) if not isinstance(skip, str) else F.lit(skip))
    return F.when(is_step, F.slice(all_steps, (at + 1).cast("int"), F.size(all_steps) + 1)).otherwise(all_steps)


def contains(d: Column | str, p: Column | str) -> Column:
    """Whether d is a directory and p is it or lies below; the root contains everything."""
    d, p = _c(d), _c(p)
    return (d == ROOT) | (d.endswith("/") & F.startswith(p, d))


def common_root(a: Column | str, b: Column | str) -> Column:
    """The deepest directory that holds both."""
    return F.element_at(F.array_intersect(ancestors(a), ancestors(b)), -1)


def depth(p: Column | str) -> Column:
    """The number of ``/``."""
    p = _c(p)
    return F.length(p) - F.length(F.translate(p, "/", ""))


def dist(a: Column | str, b: Column | str) -> Column:
    """Steps from the common root to both ends, as ``/`` in what remains of each."""
    return depth(a) + depth(b) - 2 * depth(common_root(a, b))


def atom(p: Column | str) -> Column:
    """The topmost atomic directory that is the path or holds it, or null."""
    found = F.regexp_extract(_c(p), _ATOM, 1)
    return F.when(found != "", found)


def is_atomic(name: Column | str) -> Column:
    return _c(name).isin(*ATOMS)


def path_key(p: Column | str) -> Column:
    """Sort key: root first, then name by name, at each level directories before files, names by bytes."""
    p = _c(p)
    names = parts(p)
    return F.transform(names, lambda x, i: F.struct(F.when((i == F.size(names) - 1) & ~is_dir(p), 1).otherwise(0).alias("is_file"), x.alias("name")))


def clean_path(p: Column | str) -> Column:
    """The path without ``.``, ``..`` and repeated ``/``, a directory with its ``/``; empty if not relative or not valid."""
    p = _c(p)
    raw = F.split(p, "/")

    def push(acc: Column, x: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return (
            F.when((x == "") | (x == "."), acc)
            .when((x == "..") & up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(x)))
        )

    kept = F.aggregate(raw, F.array().cast("array<string>"), push)
    plain = F.array_join(kept, "/")
    bad = p.isNull() | (p == "") | F.startswith(p, F.lit("/")) | (plain == "..") | F.startswith(plain, F.lit("../")) | (F.substring(plain, 2, 1) == ":")
    last = F.element_at(raw, -1)
    as_dir = last.isin("", ".", "..")
    return F.when(bad, "").when(plain == "", ROOT).when(as_dir, F.concat(plain, F.lit("/"))).otherwise(plain)


def dir_path(p: Column | str) -> Column:
    """The cleaned path read as a directory, or null."""
    c = clean_path(p)
    return F.when(c == "", None).when(is_dir(c), c).otherwise(F.concat(c, F.lit("/")))


def file_path(p: Column | str) -> Column:
    """The cleaned path read as a file, or null for the root."""
    c = clean_path(p)
    return F.when((c == "") | (c == ROOT), None).otherwise(F.rtrim(c, F.lit("/")))


def strict_file_path(p: Column | str) -> Column:
    """The path if it is clean and a file, else null."""
    p = _c(p)
    return F.when((clean_path(p) == p) & is_file(p), p)


def either_path(p: Column | str) -> Column:
    """Both readings of a name."""
    return F.struct(dir_path(p).alias("dir"), file_path(p).alias("file"))


def valid_name(p: Column | str) -> Column:
    """Whether an index can hold the path."""
    p = _c(p)
    return strict_file_path(p).isNotNull() & ~p.contains("\n") & ~F.startswith(p, F.lit("\t"))
