"""Classification of paths: kind of artifact, trust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered rules: kind, then names, prefixes, parts and suffixes of the path or of its last part. Fixed values.
LOCKFILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "cargo.lock", "go.sum", "poetry.lock", "pipfile.lock", "gemfile.lock", "composer.lock"]
MANIFESTS = ["package.json", "cargo.toml", "go.mod", "pyproject.toml", "requirements.txt", "gemfile", "composer.json", "pom.xml", "build.gradle"]
MIGRATION = r"^migrat(ion|e)|/migrat(ion|e)|alembic|flyway|migration[^/]*$"
SCHEMA = r"\.(prisma|graphql|gql|proto)$|schema\.sql$|(openapi|swagger)[^/]*$"
TEST = r"^(tests?|__tests__)/|/(tests?|__tests__)/|\.(test|spec)\.(ts|js)$|_test\.(go|py)$|(^|/)test_[^/]*$"
DOCUMENTATION = r"\.(md|markdown|rst)$|(^|/)(readme|license)[^/]*$|^docs/|/docs/"
CONFIG = r"(^|/)(tsconfig|\.eslint|\.prettier|docker-compose|\.env)[^/]*$|\.config\.(js|ts|mjs|json)$|(^|/)dockerfile$"


def normal(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def artifact_kind(path: Column) -> Column:
    p = normal(path)
    last = F.element_at(F.split(p, "/"), -1)
    rules = [(last.isin(LOCKFILES), "LOCKFILE"), (last.isin(MANIFESTS), "MANIFEST"), *[(p.rlike(r), k) for r, k in ((MIGRATION, "MIGRATION"), (SCHEMA, "SCHEMA"), (TEST, "TEST"), (DOCUMENTATION, "DOCUMENTATION"), (CONFIG, "CONFIG"))]]
    out = F.lit("SOURCE_FILE")
    for test, kind in reversed(rules):
        out = F.when(test, kind).otherwise(out)
    return out


def trust_level(path: Column, kind: Column, origin: Column) -> Column:
    p = normal(path)
    return (
        F.when(p.rlike("^(node_modules|vendor)/"), "DEPENDENCY")
        .when(p.rlike(r"^(dist|build)/|\.min\.js$|/generated/"), "GENERATED")
        .when(origin.isin("DEPENDENCY", "GENERATED"), origin)
        .when(origin == "CLONED_EXTERNAL", "EXTERNAL_SOURCE")
        .when(origin == "UNKNOWN", F.when(kind == "DOCUMENTATION", "UNTRUSTED").otherwise("EXTERNAL_SOURCE"))
        .when(kind.isin("CONFIG", "MANIFEST", "LOCKFILE"), "FIRST_PARTY_CONFIGURATION")
        .when(kind == "DOCUMENTATION", "FIRST_PARTY_DOCUMENTATION")
        .otherwise("FIRST_PARTY_CODE")
    )
