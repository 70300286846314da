"""Command line: load folders into a store, report what is live, ask questions, resolve conflicts, reset entities, write sample files."""

from __future__ import annotations

import argparse
import json

from .config import EngineConf, session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyforge", description=__doc__)
    p.add_argument("--store", default="facts", help="folder of the fact store")
    p.add_argument("--compat", action="store_true", help="reproduce the quirks that are known")
    commands = p.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="load the sheets, then the Word documents, of a folder")
    load.add_argument("folder")
    load.add_argument("--policy", choices=("first", "prefer", "open", "ranked"), default="first", help="how conflicts are decided")
    load.add_argument("--prefer", default="audited", help="with the policy prefer: sources that hold")
    load.add_argument("--mock", action="store_true", help="ask nobody: prefer audited sources and go live")
    load.add_argument("--report-only", action="store_true", help="load nothing, report what is live")
    load.add_argument("--skip-qualitative", action="store_true", help="sheets alone, no documents")
    commands.add_parser("report", help="what is live")
    ask = commands.add_parser("ask", help="a question about an entity")
    ask.add_argument("entity")
    ask.add_argument("question")
    ask.add_argument("--log", help="a file that calls of tools are logged to, as JSON lines")
    resolve = commands.add_parser("resolve", help="say which staged fact of a conflict holds")
    resolve.add_argument("conflict", type=int)
    resolve.add_argument("staging", type=int)
    commands.add_parser("conflicts", help="conflicts and their options")
    reset = commands.add_parser("reset", help="take an entity's files out of sight")
    reset.add_argument("entity")
    commands.add_parser("samples", help="write three sample sheets").add_argument("folder")
    return p


def run(argv: list[str] | None = None, spark=None) -> str:
    """What the command prints."""
    args = parser().parse_args(argv)
    if args.command == "samples":
        from .sources.samples import write_samples

        return "\n".join(map(str, write_samples(args.folder)))
    from .operators import gates
    from .operators.pipeline import Engine
    from .operators.router import Router
    from .sources import sheets

    spark = spark or session(EngineConf(compat=args.compat))
    engine = Engine(spark, args.store, compat=args.compat)
    if args.command == "load" and not args.report_only:
        mock = args.mock
        engine.policy, engine.prefer = ("prefer", "audited") if mock else (args.policy, args.prefer)
        engine.gate = gates.accept if mock else gates.ask()
        out = [json.dumps(engine.load_folder(args.folder), default=str)]
        if not args.skip_qualitative:
            out.append(json.dumps(engine.load_documents(sheets.list_files(spark, args.folder, (".docx",))), default=str))
        return "\n".join([*out, engine.report()])
    if args.command == "ask":
        answer = Router(engine.tools(), log_path=args.log, compat=args.compat).answer(args.entity, args.question)
        return json.dumps({"answer": answer.answer, "tool": answer.tool_name, "payload": answer.payload}, default=str, ensure_ascii=False)
    if args.command == "resolve":
        engine.resolve_conflict(args.conflict, args.staging)
    elif args.command == "reset":
        engine.reset(engine.tools().entity(args.entity))
    elif args.command == "conflicts":
        rows = engine.store.read("conflicts").orderBy("entity_id", "canonical_field", "period").collect()
        return "\n".join(json.dumps({"conflict_id": r["conflict_id"], "metric": r["canonical_field"], "period": r["period"], "state": r["state"], "options": [o.asDict() for o in r["values_seen"]]}) for r in rows)
    return engine.report()


if __name__ == "__main__":
    print(run())
