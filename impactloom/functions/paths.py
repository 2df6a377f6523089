"""Path, name and number functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Keyword lists that decide results.
CRITICAL = ("security", "auth", "redaction", "server", "payment", "billing")
TEST_PARTS = ("/tests/", "/test/", "/spec/", "/specs/", "integration-tests", "integration-testkit", "testkit", "testutil", "test-util",
              "/fixtures/", "/fuzz/", "/benches/", "/examples/")
TEST_STARTS, TEST_ENDS, TEST_BASES = ("test_", "test."), ("_test.py", "_test.go"), (".test.", ".spec.")
GENERATED_ENDS, GENERATED_BASES, GENERATED_PARTS = (".pb.go", "_pb2.py", ".g.dart", ".pb.rs"), (".gen.", "_generated"), ("generated", "/gen/")
SECURITY = ("security", "auth", "redaction", "secret", "token", "crypto")
PAYMENTS = ("payment", "billing", "invoice")
EXPOSED = ("payment", "billing", "auth", "security")
INTERESTING = ("auth", "security", "redaction", "compiler", "code-graph", "indexer", "pipeline", "billing", "config", "evaluat")
LOCKFILES = ("cargo.lock", "package-lock.json", "yarn.lock", "go.sum", "pnpm-lock.yaml", "poetry.lock", "gemfile.lock", "composer.lock")


def _any(terms) -> Column:
    return reduce(lambda a, b: a | b, terms)


def slashed(path: Column) -> Column:
    return F.translate(F.coalesce(path, F.lit("")), "\\", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def holds(path: Column, words) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    return _any(low.contains(w) for w in words)


def to_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(value.cast("string")).try_cast("bigint"), F.lit(default))


def module_of(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", 2)


def is_critical(path: Column) -> Column:
    return holds(path, CRITICAL)


def is_test(path: Column) -> Column:
    p, base = F.lower(slashed(path)), F.lower(basename(path))
    return _any([p.contains(x) for x in TEST_PARTS] + [base.startswith(x) for x in TEST_STARTS] + [base.endswith(x) for x in TEST_ENDS] + [base.contains(x) for x in TEST_BASES])


def is_generated(path: Column) -> Column:
    p, base = F.lower(slashed(path)), F.lower(basename(path))
    return _any([base.endswith(x) for x in GENERATED_ENDS] + [base.contains(x) for x in GENERATED_BASES] + [p.contains(x) for x in GENERATED_PARTS])


def is_noise(path: Column) -> Column:
    return F.lower(basename(path)).isin(*LOCKFILES) | is_generated(path)


def boundary(path: Column) -> Column:
    """The control boundary a path belongs to; security comes before payments."""
    return F.when(holds(path, SECURITY), "security").when(holds(path, PAYMENTS), "payments")


def centrality_weight(inbound: Column) -> Column:
    return F.lit(1.0) + F.log1p(F.greatest(inbound, F.lit(0)).cast("double"))


def proximity_label(weight: Column) -> Column:
    return F.when(weight >= 1.0, "changed file").otherwise("one hop away")


def percent(share: Column) -> Column:
    return F.format_string("%.0f%%", share * 100)
