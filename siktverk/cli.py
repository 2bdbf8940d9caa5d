"""Command line: ``python -m siktverk.cli run|preview|new-config|train-l1|train-l2|evaluate|sample|judge|gold``."""

from __future__ import annotations

import argparse
import importlib
import sys
from dataclasses import MISSING, fields

from siktverk.operators import judging, sampling
from siktverk.plans import pipeline
from siktverk.plans.config import PROVIDERS, Gold, Pipeline, Priority, Ranking, load_config, save_config
from siktverk.plans.session import local_session
from siktverk.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siktverk")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict], config: bool = True) -> None:
        c = sub.add_parser(name)
        if config:
            c.add_argument("config")
        for o, kw in options:
            c.add_argument(o, **kw)

    needed = {"required": True}
    command("run")
    command("preview")
    command("new-config", ("--k", {"type": int, "default": 100}), ("--m", {"type": float, "default": 10}), ("--l2-mode", {"default": "prototype"}), ("--credits", {"nargs": 7, "type": float}))
    command("train-l1", ("--labels", needed), ("--output", needed))
    command("train-l2", ("--labels", needed), ("--output", needed))
    command("evaluate", ("--labels", needed), ("--markdown", {}), ("--json", {}), ("--external", {"action": "store_true"}))
    command("sample", ("--input", needed), ("--output", needed), ("--size", {"type": int, "default": 2000}), ("--mode", {"choices": ("uniform", "proportional"), "default": "uniform"}), ("--seed", {"type": int, "default": 42}), config=False)
    command("judge", ("--texts", needed), ("--prompt", needed), ("--output", needed), ("--done", {}), ("--budget", {"type": float}), ("--estimate-only", {"action": "store_true"}), config=False)
    options: list[tuple[str, dict]] = [("--scorer", {"help": "module:function that answers a prompt; the offline one without it"})]
    for f in fields(Gold):
        flag, kind = f"--{f.name.replace('_', '-')}", str(f.type).split(" ")[0]
        choices = {"mode": ("uniform", "proportional"), "provider": tuple(PROVIDERS)}.get(f.name)
        kw: dict = {"action": "store_true"} if kind == "bool" else {"type": {"int": int, "float": float}.get(kind, str), "choices": choices} | (needed if f.default is MISSING else {"default": f.default})
        options.append((flag, kw))
    command("gold", *options, config=False)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "new-config":
        from siktverk.operators.features import FEATURES

        priority = Priority(dict(zip(FEATURES, a.credits))) if a.credits else Priority()
        save_config(Pipeline(priority=priority, ranking=Ranking(k=a.k, m=a.m, l2_mode=a.l2_mode)), a.config)
        return 0
    spark = local_session()
    if a.command == "sample":
        strata = ["edu_ord", "quality_ord"]
        pool = sampling.with_strata(readers.read_local(spark, a.input))
        drawn = sampling.stratified_sample(pool, strata, a.size, a.mode, a.seed)
        sinks.manifest(drawn, ["id", *strata, "stratum_weight"]).write.mode("overwrite").parquet(a.output)
        return 0
    if a.command == "gold":
        scorer = judging.stub
        if a.scorer:
            module, _, name = a.scorer.partition(":")
            scorer = getattr(importlib.import_module(module), name)
        print(pipeline.gold(spark, Gold(**{f.name: getattr(a, f.name) for f in fields(Gold)}), scorer))
        return 0
    if a.command == "judge":
        texts = readers.read_local(spark, a.texts)
        with open(a.prompt, encoding="utf-8") as f:
            template = f.read()
        usd = judging.cost(texts, len(template), 0.27, 0.54).first()["usd"]
        print(f"estimated cost: {usd:.2f} USD")
        if a.estimate_only:
            return 0
        if a.budget is not None and usd > a.budget:
            return 1
        done = readers.read_local(spark, a.done) if a.done else None
        judging.judge(texts, template, done=done).write.mode("append").parquet(a.output)
        return 0
    config = load_config(a.config)
    if a.command in ("run", "preview"):
        out = pipeline.run(spark, config, write=a.command == "run")
        if a.command == "preview":
            print(sinks.preview(out, config.ranking.k))
        return 0
    labels = readers.read_local(spark, a.labels)
    if a.command == "train-l1":
        print(pipeline.train_l1(spark, config, labels, a.output).recall)
    elif a.command == "train-l2":
        pipeline.train_l2(spark, config, labels, a.output)
    else:
        result = pipeline.evaluate(spark, config, labels, a.external)
        print(pipeline.evaluation_report(result, {"labels": a.labels}, pipeline.load_l1(config.l1_model).weights, a.markdown, a.json))
    return 0


if __name__ == "__main__":
    sys.exit(main())
