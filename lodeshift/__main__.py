"""python -m lodeshift COMMAND: documents and job descriptions from files to tables.

run FOLDER JOB        ranks a folder of documents for a job description
run-all FOLDER JOBS   the same for a folder of job descriptions
parse FOLDER          the sections and dated roles found in the documents
compile-jd JOB        the skills and needs found in a job description
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="lodeshift", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "run-all"):
        c = commands.add_parser(name)
        c.add_argument("folder")
        c.add_argument("job")
        c.add_argument("--out", help="folder of the written tables; else they are shown")
        c.add_argument("--threshold", type=float, default=70.0)
        c.add_argument("--top", type=int)
    for name, what in (("parse", "folder"), ("compile-jd", "job")):
        c = commands.add_parser(name)
        c.add_argument(what)
        c.add_argument("--out")
    a = parser.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lodeshift.plans import pipeline
    from lodeshift.sources import files

    spark = SparkSession.builder.appName("lodeshift").getOrCreate()

    def put(name: str, frame) -> None:
        if a.out:
            frame.write.mode("overwrite").json(f"{a.out}/{name}")
        else:
            frame.show(50, truncate=60)

    def jobs(path: str):
        name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), "[.][^.]*$", "")
        return spark.read.text(path, wholetext=True).select(name.alias("job_id"), F.col("value").alias("text"))

    if a.command == "compile-jd":
        skills, needs = pipeline.compile_jobs(jobs(a.job))
        put("skills", skills)
        put("needs", needs)
        return 0
    documents = files.extract(files.load_folder(spark, a.folder)).where("text is not null").select("candidate_id", "text")
    if a.command == "parse":
        profiles, roles, _ = pipeline.structure(documents)
        put("profiles", profiles)
        put("roles", roles)
        return 0
    asked = jobs(a.job)
    result = pipeline.shortlist(documents, asked, a.threshold, a.top)
    if a.out:
        flat = result.withColumn("missing", F.array_join("missing", ";")).withColumn("flags", F.array_join("flags", ";"))
        files.write_scores(flat, f"{a.out}/scores")
        hashes = asked.select("job_id", files.hash_of(F.col("text")).alias("jobspec_sha256"))
        files.write_audit(result.join(hashes, "job_id"), f"{a.out}/audit")
    else:
        result.orderBy("job_id", "rank").show(50, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
