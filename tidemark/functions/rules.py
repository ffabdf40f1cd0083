"""Rule predicates and rewrites as columns; results are the strings 'true', 'false', '' or a value."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.once import once


def _said(condition: Column, negate: bool = False) -> Column:
    return F.coalesce((~condition if negate else condition).cast("string"), F.lit(""))


def string_rule(op: str, value: Column, argument: str, negate: bool = False) -> Column:
    """eq, contains, prefix, suffix (with negation), rmatch (without), md5, sha1, base64, modulo."""
    if op == "rmatch":
        try:
            re.compile(argument)
        except re.error:
            return F.lit("false")
        return _said(value.rlike(argument))
    tests = {"eq": lambda: value == argument, "contains": lambda: value.contains(argument), "prefix": lambda: value.startswith(argument), "suffix": lambda: value.endswith(argument)}
    if op in tests:
        return _said(tests[op](), negate)
    if op == "modulo":
        try:
            n = int(argument)
        except ValueError:
            return F.lit("")
        if not n:
            return F.lit(None).cast("string")
        pairs = F.regexp_extract_all(F.hex(F.encode(value, "UTF-8")), F.lit("(..)"), F.lit(1))
        return (F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + F.conv(x, 16, 10).cast("long")) % n).cast("string")
    return {"md5": F.md5, "sha1": F.sha1, "base64": lambda v: F.base64(F.encode(v, "UTF-8"))}[op](value)


def number_rule(op: str, value: Column, argument: str, negate: bool = False) -> Column:
    """eq, gt, lt, ge, le, bt ('lo-hi', both ends in), modulo; '' where either isn't a number."""
    v = value.try_cast("double")
    if op == "bt":
        # Split at the first hyphen; a negative lower bound is no number then.
        low, _, high = argument.partition("-")
        a, b = (F.lit(x).try_cast("double") for x in (low, high))
        return _said(v.between(a, b), negate)
    a = F.lit(argument).try_cast("double")
    if op == "modulo":
        return F.when(F.abs(a) >= 1, (v.cast("long") % a.cast("long")).cast("string")).otherwise(F.when(a.isNull(), F.lit("")))
    return _said({"eq": v == a, "gt": v > a, "lt": v < a, "ge": v >= a, "le": v <= a}[op], negate)


def bool_rule(value: Column, argument: str, negate: bool = False) -> Column:
    return _said(value.try_cast("boolean") == F.lit(argument).try_cast("boolean"), negate)


def part(value: Column, delimiter: str, n: int) -> Column:
    """The n-th part (from 0), or ''."""
    return F.coalesce(F.get(F.split(value, re.escape(delimiter)), F.lit(n)), F.lit(""))


def url_part(url: Column, name: str, key: str | None = None) -> Column:
    """scheme, host, hostname, port, path, params, param (of ``key``) or url_no_params."""
    host = F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    plain = {
        "scheme": F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1), "host": host, "hostname": F.regexp_replace(host, ":[0-9]+$", ""), "port": F.regexp_extract(host, ":([0-9]+)$", 1),
        "path": F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "params": F.regexp_extract(url, r"\?([^#]*)", 1), "url_no_params": F.regexp_replace(url, r"[?#].*$", ""),
    }
    return F.regexp_extract(url, rf"[?&]{re.escape(key or '')}=([^&#]*)", 1) if name == "param" else plain[name]


def from_base64(text: Column) -> Column:
    """The decoded input; '' where it isn't base64."""
    whole = text.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(whole, F.coalesce(F.decode(F.unbase64(F.when(whole, text)), "UTF-8"), F.lit(""))).otherwise("")


def header(headers: Column, name: str) -> Column:
    """Value of a header by its name in any case; '' if absent."""
    found = F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name.lower()))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def expand(template: str, value: Column, pattern: str) -> Column:
    """``template`` with ${0}, ${1} or ${name} replaced by what ``pattern`` captures in ``value``; unknown names stay, as all do without a match."""
    groups = re.compile(pattern)
    names = {str(i): i for i in range(groups.groups + 1)} | dict(groups.groupindex)
    java = re.sub(r"\(\?P<", "(?<", pattern)
    parts = re.split(r"\$\{([^}]*)\}", template)
    filled = [F.lit(x) if i % 2 == 0 else F.regexp_extract(value, java, names[x]) if x in names else F.lit("${" + x + "}") for i, x in enumerate(parts)]
    return F.when(value.rlike(java), F.concat(*filled)).otherwise(F.lit(template))


def decide_each(value: Column, cases: list[tuple[Column, str]], default: str) -> Column:
    """The case-argument form: each case has its own predicate on the input ('true' holds), and the last that holds wins."""
    return reduce(lambda rest, c: F.when(c[0] == "true", F.lit(c[1])).otherwise(rest), cases, F.lit(default))


def _split(url: Column, body) -> Column:
    """``body`` of a URL's scheme, host, port, path and query, each worked out once; of '://' there must be one. What is behind '#' is dropped."""
    scheme = F.substring_index(url, "://", 1)
    rest = F.substring_index(F.substr(url, F.length(scheme) + 4), "#", 1)
    # By string functions: a pattern with a group for each part is matched anew for every group.
    named = lambda u: F.struct(scheme.alias("scheme"), u.alias("rest"), F.substring_index(u, "?", 1).alias("plain"))
    hosted = lambda r: F.struct(r["scheme"].alias("scheme"), r["rest"].alias("rest"), r["plain"].alias("plain"), F.substring_index(F.substring_index(r["plain"], "/", 1), ":", 1).alias("host"))
    behind = lambda r: F.substr(r["plain"], F.length(r["host"]) + 1)
    ported = lambda r: F.struct(r.alias("r"), behind(r).alias("behind"), F.regexp_extract(behind(r), "^:([0-9]+)", 1).alias("port"))

    def parts(x: Column) -> Column:
        r = x["r"]
        path = F.when(x["port"] == "", x["behind"]).otherwise(F.substr(x["behind"], F.length(x["port"]) + 2))
        return body(r["scheme"], r["host"], x["port"], path, F.substr(r["rest"], F.length(r["plain"]) + 2))

    return once(rest, lambda u: once(named(u), lambda r: once(hosted(r), lambda h: once(ported(h), parts))))


def _join(scheme: Column, host: Column, port: Column, path: Column, query: Column) -> Column:
    led = lambda mark, text: once(text, lambda t: F.when(t != "", F.concat(F.lit(mark), t)).otherwise(""))
    return F.concat(scheme, F.lit("://"), host, led(":", port), path, led("?", query))


def rewrite(url: Column, part: str, how: str, *args: str) -> Column:
    """``url`` with a part rewritten.

    part: scheme, host (name and port), hostname, port, path, params, param.
    how: 'set' (value), 'replace' (search, value), 'delete' (port, params,
    param), 'append' (param). path 'set' and 'replace' take a depth last: that
    path segment alone, from 0. param takes its name first; its 'replace' and
    'delete' may be held to one value.
    """
    held = lambda u: F.when(u.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), _split(u, lambda *parts: _rewrite_parts(*parts, part, how, *args))).otherwise(u)
    return once(url, held)


def _rewrite_parts(scheme: Column, host: Column, port: Column, path: Column, query: Column, part: str, how: str, *args: str) -> Column:
    edit = lambda old: F.lit(args[0]) if how == "set" else F.replace(old, F.lit(args[0]), F.lit(args[1])) if how == "replace" else F.lit("")
    if part == "scheme":
        scheme = edit(scheme)
    elif part == "hostname":
        host = edit(host)
    elif part == "port":
        port = edit(port)
    elif part == "host":
        both = edit(F.when(port == "", host).otherwise(F.concat(host, F.lit(":"), port)))
        host, port = F.substring_index(both, ":", 1), F.regexp_extract(both, ":([0-9]+)$", 1)
    elif part == "path":
        depth = args[1 if how == "set" else 2] if len(args) > (1 if how == "set" else 2) else None
        if depth is None:
            path = edit(path)
        else:
            segments = F.split(F.substr(path, F.lit(2)), "/")
            path = F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s, i: F.when(i == int(depth), edit(s)).otherwise(s)), "/"))
    elif part == "params":
        query = edit(query)
    else:
        query = _rewrite_param(query, how, *args)
    return _join(scheme, host, port, path, query)


def _rewrite_param(query: Column, how: str, name: str, *args: str) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    mine = lambda p: F.substring_index(p, "=", 1) == name
    value = lambda p: F.substr(p, F.lit(len(name) + 2))
    made = lambda v: F.array(F.lit(f"{name}={v}"))
    if how == "set":
        out = F.concat(F.filter(pairs, lambda p: ~mine(p)), made(args[0]))
    elif how == "append":
        out = F.concat(pairs, made(args[0]))
    elif how == "delete":
        out = F.filter(pairs, lambda p: ~(mine(p) & (value(p) == args[0]) if args else mine(p)))
    else:
        out = F.transform(pairs, lambda p: F.when(mine(p), F.concat(F.lit(f"{name}="), F.replace(value(p), F.lit(args[0]), F.lit(args[1])))).otherwise(p))
    return F.array_join(out, "&")


def rewrite_all(url: Column, steps: list[tuple]) -> Column:
    """A chain of rewrites, each on the outcome of the one before, which is worked out once."""
    return reduce(lambda u, step: rewrite(u, *step), steps, url)


def rewrite_header(headers: Column, how: str, name: str, *args: str) -> Column:
    """A header map with one header set, appended to, replaced in, or deleted."""
    rest = F.map_filter(headers, lambda k, _: F.lower(k) != name.lower())
    old = header(headers, name)
    if how == "delete":
        return rest
    new = {"set": lambda: F.lit(args[0]), "append": lambda: F.when(old == "", F.lit(args[0])).otherwise(F.concat(old, F.lit(", " + args[0]))), "replace": lambda: F.replace(old, F.lit(args[0]), F.lit(args[1]))}[how]()
    return F.map_concat(rest, F.create_map(F.lit(name), new))


def decide(value: Column, cases: list[tuple[str, str]], default: str) -> Column:
    """The outcome of the last case whose match equals ``value``."""
    return reduce(lambda rest, c: F.when(value == c[0], F.lit(c[1])).otherwise(rest), cases, F.lit(default))
