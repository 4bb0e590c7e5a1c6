"""python -m factloom.cli validate-rules RULES | scan FOLDER --rules RULES --output REPORT | check FACTS --rules RULES --output REPORT

FOLDER: a repository of Java modules with POMs. FACTS: a folder of parquet relations.
"""

from __future__ import annotations

import sys
import threading
from pathlib import Path

from factloom import __version__
from factloom.plans.model import FactError, FactModel

OK, VIOLATION, USAGE, FAILED = 0, 2, 64, 70


def _load(rules_path: str):
    from factloom.plans import ruleset

    try:
        return ruleset.load(rules_path)
    except FactError as e:
        print("ERROR", e, file=sys.stderr)
        return None


def _in_time(work, seconds: int, spark):
    """What work returns; a FactError after so many seconds. The worker can write nothing, so a late one does no harm."""
    box: dict = {}

    def run() -> None:
        try:
            box["value"] = work()
        except BaseException as e:  # noqa: BLE001
            box["error"] = e

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(seconds)
    if worker.is_alive():
        spark.sparkContext.cancelAllJobs()
        raise FactError("scanner.limit.duration")
    if "error" in box:
        raise box["error"]
    return box["value"]


def _evaluated(spark, rules, model_of, output: str) -> int:
    """Evaluates the rules over the model that model_of() gives with its parse diagnostics; writes the report, prints diagnostics."""
    from factloom.plans import engine
    from factloom.sources import reports

    def work():
        f, parse = model_of()
        findings, diagnostics = engine.evaluate(f, rules.rules, rules.budgets())
        findings, diagnostics = findings.persist(), diagnostics.persist()
        bodies = [r.body for r in reports.to_json(f, findings).collect()]
        if len(bodies) != 1:
            raise FactError("report.validation.failed", "one project per report")
        said = [] if parse is None else [f"{d.code} {d.path}:{d.line}:{d.column} {d.message}" for d in parse.orderBy("code", "path", "line", "column", "message").toLocalIterator()]
        said += [f"{d.code} {d.subject_id} {d.message}" for d in diagnostics.orderBy("code", "subject_id", "message").toLocalIterator()]
        return bodies[0].encode(), said, findings.count(), engine.exit_code(findings, diagnostics, rules.fail_on)

    try:
        body, said, n, status = _in_time(work, rules.limits["maxDurationSeconds"], spark)
        reports.write_atomic(output, body, rules.limits["maxOutputBytes"])
    except FactError as e:
        print("ERROR", e, file=sys.stderr)
        return USAGE if e.code in ("java.path.invalid-root", "java.path.root-symlink") else FAILED
    for line in said:
        print("ERROR", line, file=sys.stderr)
    print(f"findings={n} diagnostics={len(said)}")
    return FAILED if said else status


def _check(facts_dir: str, rules_path: str, output: str) -> int:
    from factloom.session import local_session

    rules = _load(rules_path)
    if rules is None:
        return USAGE
    if not Path(facts_dir).is_dir():
        print("ERROR cli.input.invalid", file=sys.stderr)
        return USAGE
    spark = local_session("*")
    return _evaluated(spark, rules, lambda: (FactModel(*(spark.read.parquet(f"{facts_dir}/{n}.parquet") for n in FactModel.__dataclass_fields__)), None), output)


def _scan(root: str, rules_path: str, output: str) -> int:
    from factloom.session import local_session
    from factloom.sources.discovery import ScanLimits
    from factloom.sources.scan import scan

    rules = _load(rules_path)
    if rules is None:
        return USAGE
    most = rules.limits
    limits = ScanLimits(most["maxFiles"], most["maxFileBytes"], most["maxTotalBytes"], most["maxDepth"])
    spark = local_session("*")
    return _evaluated(spark, rules, lambda: scan(spark, root, rules.identity, rules.name, limits), output)


def main(argv: list[str]) -> int:
    if argv in (["--help"], ["--version"]):
        print(__doc__ if argv == ["--help"] else __version__)
        return OK
    if len(argv) == 2 and argv[0] == "validate-rules":
        from factloom.plans import ruleset

        try:
            r = ruleset.load(argv[1])
        except FactError as e:
            print(e.code, file=sys.stderr)
            return USAGE
        print(f"rules valid: version=0.1.0 rules={len(r.rules)}")
        return OK
    commands = {"check": _check, "scan": _scan}
    if len(argv) == 6 and argv[0] in commands and argv[2] == "--rules" and argv[4] == "--output":
        return commands[argv[0]](argv[1], argv[3], argv[5])
    print(__doc__, file=sys.stderr)
    return USAGE


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
