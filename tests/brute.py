"""Plain Python versions of the core operators, for small inputs."""

import json
import re
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

WS = r"[\s   -     　\x1c-\x1f\x85]"


def trim(s):
    return None if s is None else re.sub(f"^{WS}+|{WS}+$", "", s)


def full(s):
    return trim(s) or None


def resolve(value, props):
    value = full(value)
    for _ in range(16):
        if value is None:
            return None
        names = re.findall(r"\$\{([^}]+)\}", value)
        if not names:
            return full(value)
        if any(props.get(n) is None for n in names):
            return None
        value = re.sub(r"\$\{([^}]+)\}", lambda m: props[m[1]], value)
    return None


def pom_links(rows):
    best = {}
    for r in rows:
        props = dict(r["pom_properties"] or [])
        pg, pa, pv = full(r["parent_group_id"]), full(r["parent_artifact_id"]), full(r["parent_version"])
        props |= {k: v for k, v in (("parent.groupId", pg), ("parent.artifactId", pa), ("parent.version", pv)) if v}
        g, a = resolve(full(r["group_id"]) or pg, props), resolve(r["artifact_id"], props)
        if not g or not a:
            continue
        up = None
        if (x := resolve(pg, props)) and (y := resolve(pa, props)):
            up = f"{x}:{y}"
        got = (r["scanned_at"] or datetime.min, up or "")
        if got >= best.get(f"{g}:{a}", (datetime.min, "")):
            best[f"{g}:{a}"] = got
    return {k: v[1] or None for k, v in best.items()}


def hierarchy(links):
    """key -> (root, depth, path list or None, cycle members or None)"""
    links = {k: (p if p in links else None) for k, p in links.items()}
    out = {}
    for k in links:
        path, at, seen = [k], links[k], {k}
        while at is not None and at not in seen:
            path.append(at)
            seen.add(at)
            at = links[at]
        if at is None:
            out[k] = (path[-1], len(path) - 1, path[::-1], None)
        else:
            ring, x = [at], links[at]
            while x != at:
                ring.append(x)
                x = links[x]
            out[k] = (None, -1, None, sorted(ring))
    return out


def snapshot_changes(rows):
    low = lambda s: None if s is None else trim(s).lower()
    snaps = defaultdict(dict)
    for r in rows:
        k = low(r["finding_id"])
        if not k or r["snapshot_no"] is None:
            continue
        got = (r["loaded_at"] or datetime.min, (low(r["severity"]), low(r["fingerprint"])))
        old = snaps[r["snapshot_no"]].get(k)
        if old is None or got[0] > old[0]:
            snaps[r["snapshot_no"]][k] = got
    out = set()
    for a, b in zip(sorted(snaps), sorted(snaps)[1:]):
        x, y = snaps[a], snaps[b]
        out |= {(b, k, "added") for k in y.keys() - x.keys()} | {(b, k, "removed") for k in x.keys() - y.keys()}
        out |= {(b, k, "changed") for k in x.keys() & y.keys() if x[k][1] != y[k][1]}
    return out


def report_facts(rows):
    out = set()

    def reports(v, deep=0):
        if isinstance(v, list):
            for x in v:
                yield from reports(x, deep)
        elif isinstance(v, str) and deep < 3:
            try:
                yield from reports(json.loads(v), deep + 1)
            except ValueError:
                return
        elif isinstance(v, dict):
            if isinstance(v.get("report"), dict):
                yield from reports(v["report"], deep + 1)
            elif isinstance(v.get("payload"), str):
                yield from reports(v["payload"], deep + 1)
            else:
                yield v

    def entities(v):
        if isinstance(v, list):
            return [(x["id"], x) for x in v if isinstance(x, dict) and x.get("id")]
        if isinstance(v, dict):
            return [(v["id"], v)] if isinstance(v.get("id"), str) else [(x.get("id", k), x) for k, x in v.items() if isinstance(x, dict)]
        return []

    def texts(v):
        if isinstance(v, list):
            return [t for x in v for t in ([] if isinstance(x, (dict, list)) or x is None else [str(x)])]
        return [] if v is None or isinstance(v, dict) else [str(v)]

    def pairs(v, prefix=""):
        for k, x in v.items():
            for t in texts(x):
                yield prefix + k, t
            if isinstance(x, dict):
                yield from pairs(x, prefix + k + ".")

    def owner(rid, kind, i, b):
        loc = b.get("location")
        if isinstance(loc, dict):
            s, e = loc.get("start") or {}, loc.get("end") or {}
            xs = [loc.get("startLine", s.get("line")), loc.get("startColumn", s.get("column")), loc.get("endLine", e.get("line")), loc.get("endColumn", e.get("column"))]
            if loc.get("path") is not None and None not in xs:
                out.add((rid, kind, i, "location", "{}:{}:{}-{}:{}".format(loc["path"], *xs)))
        ext = b.get("extensions")
        got = [(r["key"], t) for r in ext for t in texts(r.get("values"))] if isinstance(ext, list) else list(pairs(ext)) if isinstance(ext, dict) else []
        out.update((rid, kind, i, "extension", f"{k}={t}") for k, t in got)
        if kind == "finding":
            for t in texts(b.get("evidenceIds")) + [j for j, _ in entities(b.get("evidences"))]:
                out.add((rid, kind, i, "evidence", t))

    for r in rows:
        try:
            body = json.loads(r["body"])
        except (ValueError, TypeError):
            continue
        for rep in reports(body):
            arts = entities(rep.get("artifacts"))
            comps = entities(rep.get("components")) + [c for _, a in arts for c in entities(a.get("components"))]
            finds = entities(rep.get("findings")) + [f for _, o in arts + comps for f in entities(o.get("findings"))]
            for i, b in comps:
                owner(r["report_id"], "component", i, b)
            for i, b in finds:
                owner(r["report_id"], "finding", i, b)
    return out


def _plain(d):
    s = format(d, "f")
    return s.rstrip("0").rstrip(".") if "." in s else s


def _time(v):
    if re.fullmatch(r"\d{10}|\d{13}", v):
        return datetime(1970, 1, 1) + timedelta(seconds=int(v[:10]))
    try:
        t = datetime.fromisoformat(v)
    except ValueError:
        return None
    if t.utcoffset() is not None:
        t = (t - t.utcoffset()).replace(tzinfo=None)
    return t


def read_cell(v, kind):
    v = full(v)
    if v is None:
        return None
    if kind == "string":
        return v
    if kind == "int":
        return str(int(v.replace(",", "").split(".")[0])) if re.fullmatch(r"[+-]?(\d+|\d{1,3}(,\d{3})+)(\.0+)?", v) else None
    if kind == "decimal":
        return _plain(Decimal(v.replace(",", "."))) if re.fullmatch(r"[+-]?\d+([.,]\d+)?([eE][+-]?\d+)?", v) else None
    if kind == "boolean":
        low = v.lower()
        return "true" if low in ("true", "t", "yes", "y", "1", "on") else "false" if low in ("false", "f", "no", "n", "0", "off") else None
    if kind == "timestamp":
        t = _time(v)
        return t and t.strftime("%Y-%m-%dT%H:%M:%SZ")
    for f in ("%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%d %b %Y"):
        try:
            return datetime.strptime(v, f).strftime("%Y-%m-%d")
        except ValueError:
            pass
    t = _time(v) if ":" in v else None
    return t and date(t.year, t.month, t.day).isoformat()


def filled_cells(rows, keys):
    norm = lambda s: re.sub(WS + "+", "", s).lower().replace("_", "-")
    reg = {(k["entity_kind"], norm(k["ext_key"])): (k["ext_key"], k["value_type"]) for k in keys}
    last, lists = {}, defaultdict(set)
    for r in rows:
        if r["entity_id"] is None or r["ext_key"] is None or (got := reg.get((r["entity_kind"], norm(r["ext_key"])))) is None:
            continue
        at = (r["entity_id"], *got)
        v = r["ext_value"]
        if got[1] == "string_list":
            t = trim(v)
            lists[at] |= {x for x in (map(full, json.loads(t)) if t and t.startswith("[") else [full(v)]) if x}
        else:
            new = (r["loaded_at"] or datetime.min, v or "", v)
            if at not in last or new > last[at]:
                last[at] = new
    out = {(e, k, c) for (e, k, t), (_, _, v) in last.items() if (c := read_cell(v, t)) is not None}
    return out | {(e, k, "|".join(sorted(s))) for (e, k, _), s in lists.items() if s}
