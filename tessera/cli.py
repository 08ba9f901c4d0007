"""Command line: the four steps of a run, each a Spark job.

    python -m tessera.cli load     --config cfg.json --intake in/ --staging st/
    python -m tessera.cli validate --config cfg.json --staging st/ --catalogs cat/ --out out/
    python -m tessera.cli profile  --config cfg.json --staging st/ --out out/ [--exact]
    python -m tessera.cli publish  --config cfg.json --staging st/ --target tgt/ --out out/

Each step prints one JSON line with its outcome; a refused publish exits 1.
"""

from __future__ import annotations

import argparse
import json
import sys

from tessera.model import DataModel
from tessera.session import get_session, path_exists


def _staged(spark, model, staging):
    if not path_exists(spark, staging):
        raise FileNotFoundError(f"no staged tables at {staging}")
    return {ent.name: spark.read.parquet(f"{staging}/{ent.name}") for ent in model.entities
            if path_exists(spark, f"{staging}/{ent.name}")}


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="tessera")
    ap.add_argument("step", choices=["load", "validate", "profile", "publish"])
    ap.add_argument("--config", required=True)
    ap.add_argument("--intake")
    ap.add_argument("--staging", required=True)
    ap.add_argument("--catalogs")
    ap.add_argument("--out")
    ap.add_argument("--target")
    ap.add_argument("--exact", action="store_true")
    ap.add_argument("--master")
    a = ap.parse_args(argv)
    spark = get_session(a.master)
    model = DataModel.from_json(a.config)

    if a.step == "load":
        from tessera.plans.ingest import load_model
        res = load_model(spark, a.intake, model, a.staging)
        print(json.dumps([r.asDict() for r in res.collect()]))
    elif a.step == "validate":
        from tessera.plans.report import version_stamp, write_validation
        from tessera.plans.validation import validate_staged
        rec = validate_staged(spark, model, a.staging, a.catalogs or ".")
        path = write_validation(version_stamp(rec, model), a.out) if rec is not None else None
        print(json.dumps({"validator_output": path}))
    elif a.step == "profile":
        from tessera.plans.report import write_profiles
        names = write_profiles(spark, model, _staged(spark, model, a.staging), a.out, exact=a.exact)
        print(json.dumps({"profiles": names}))
    else:
        from tessera.operators.publish import PublishError, publish
        try:
            rep = publish(spark, model, _staged(spark, model, a.staging), a.target, quarantine_dir=a.out)
        except PublishError as e:
            print(json.dumps({"error": str(e)}))
            return 1
        print(json.dumps(rep))
    return 0


if __name__ == "__main__":
    sys.exit(main())
