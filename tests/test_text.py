"""Scalar functions on known inputs."""

import pytest
from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.operators.change import file_category


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_url_normalisation(spark):
    table = {
        "/api/v1/users/{id}": "/api/v1/users/:param", "/api/users/:id": "/api/users/:param", "/api/users/${userId}": "/api/users/:param",
        "/api/users/": "/api/users", "/api/users?page=1&size=10": "/api/users", "/API/Users": "/api/users", "http://localhost:3000/api/users": "/api/users",
        "api/users": "/api/users", "/": "/", "": "/", "https://api.example.com/API/v1/Users/{userId}/?fields=name": "/api/v1/users/:param",
    }
    assert column(spark, list(table), text.normalize_url_path) == list(table.values())


def test_symbols(spark):
    table = {
        "semanticdb maven maven/org.example/myapp 1.0 com/example/UserService#": ("com.example.UserService", "class"),
        "semanticdb maven maven/org.example/myapp 1.0 com/example/UserService#createUser().": ("com.example.UserService.createUser", "function"),
        "maven . com/example 1.0 UserService#": ("com.example.UserService", "class"),
        "local 42": ("", "local"), "": ("", None), "a b c d f().(param)": ("", "parameter"), "a b c d f().[T]": ("", "parameter"),
        "scip-python python @pkg/x 1 `mod`/A#f.": ("pkg.x.mod.A.f", "field"),
    }
    assert column(spark, list(table), text.scip_symbol_to_fqn) == [v[0] for v in table.values()]
    assert column(spark, list(table), text.scip_descriptor_kind) == [v[1] for v in table.values()]


def test_hunks(spark):
    patch = "@@ -1,2 +3,4 @@\n x\n@@ -7 +9 @@ def f"
    got = column(spark, [patch, None, ""], text.patch_hunks)
    assert [tuple(h) for h in got[0]] == [(1, 2, 3, 4), (7, 1, 9, 1)] and got[1:] == [[], []]


def test_categories(spark):
    table = {
        "src/main/java/com/example/Foo.java": "source", "src/components/App.tsx": "source", "something.xyz": "source", "tests/unit/test_foo.py": "test", "src/foo.spec.ts": "test",
        "Dockerfile": "infra", "docker-compose.yml": "infra", ".github/workflows/ci.yml": "infra", ".env": "config", "application.yml": "config",
        "db/migrations/V1__init.sql": "migration", "alembic/versions/001_init.py": "migration", "README.md": "docs",
    }
    assert column(spark, list(table), file_category) == list(table.values())


def test_names(spark):
    assert column(spark, ["firstName", "HTTPServer", "User2Go"], text.camel_to_snake) == ["first_name", "http_server", "user2_go"]
    assert column(spark, ["bus", "city", "boy", "user", "y"], text.pluralize) == ["buses", "cities", "boys", "users", "ys"]
    assert column(spark, ["OrderItem"], text.snake_each_capital) == ["order_item"]
    assert column(spark, ["Map<String, List<User>>", "Plain", ""], text.bare_types) == [["Map", "String", "List"], ["Plain"], []]
    assert column(spark, ["a.b.c.d", "a"], text.third_segment) == ["c", ""]


@pytest.mark.parametrize("prefix,path,want", [("/a/", "/b", "/a/b"), ("/a", "b", "/a/b"), ("", "b", "b"), ("/a", "", "/a"), ("/a", "/b", "/a/b")])
def test_join_paths(spark, prefix, path, want):
    assert spark.range(1).select(text.join_paths(F.lit(prefix), F.lit(path))).first()[0] == want


def test_routes(spark):
    row = spark.range(1).select(
        text.combine_route(text.controller_route(F.lit("api/[controller]"), F.lit("UserController")), F.lit("{id:int}/[action]"), F.lit("Get")),
        text.combine_route(F.lit(""), F.lit(""), F.lit("x")), text.collapse_slashes(F.lit("a//b///c")),
    ).first()
    assert tuple(row) == ("/api/user/:id/get", "/", "/a/b/c")


def test_flyway_and_loc(spark):
    assert column(spark, ["V1__create_users.sql", "V1.2__x.sql", "U1__x.sql"], text.flyway_version) == ["1", "1.2", None]
    assert column(spark, ["V1__create_users.sql"], text.flyway_description) == ["create_users"]
    assert column(spark, ["a\r\n\n  // c\n# x\n * y\n-- z\n/* w\n b"], text.count_loc) == [2]
    raw = spark.createDataFrame([(b"a\nb",), (b"\xff\xfe\n",)], "c binary")
    assert [r[0] for r in raw.select(text.count_loc_bytes(F.col("c"))).collect()] == [2, 0]


def test_literals(spark):
    assert column(spark, ["['a', \"b\"]"], text.quoted_strings) == [["a", "b"]]
    assert column(spark, ["Field(min_length=3, title='x', pattern=\"a\", ge=f(1))"], text.field_constraints) == [{"min_length": "3", "pattern": "a", "ge": "f(1)"}]
    assert column(spark, ["{'default': {'ENGINE': 'pg', 'NAME': \"n\", 'PORT': 5432}}"], text.default_database) == [{"default_engine": "pg", "default_name": "n"}]


def test_cost_is_decimal(spark):
    row = spark.range(1).select(text.usage_cost(F.lit(1234567).cast("bigint"), F.lit(89).cast("bigint"), "3.0", "15.0")).first()
    assert str(row[0]) == "3.705036"
