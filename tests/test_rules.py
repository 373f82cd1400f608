"""Endpoint shapes that the driver tables do not cover."""

from graphlens.operators.rules import endpoints, mapping, schema_history


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_remote_services(make_graph, spark):
    g = make_graph(
        [
            {"fqn": "S", "kind": "CLASS", "name": "GreeterService", "base_class": "Greeter.GreeterBase"}, {"fqn": "S.Hello", "kind": "FUNCTION", "props": {"is_override": "true"}},
            {"fqn": "S.Own", "kind": "FUNCTION"},
        ],
        [("S", "S.Hello", "CONTAINS"), ("S", "S.Own", "CONTAINS")],
    )
    out = endpoints.remote_services(g, spark.createDataFrame([("GreeterService",)], "name string"))
    assert got(out.edges, "src", "dst", "kind") == [("S", "endpoint:GRPC:/Greeter/Hello", "EXPOSES"), ("S.Hello", "endpoint:GRPC:/Greeter/Hello", "HANDLES")]
    assert got(out.entry_points, "fqn", "kind") == [("S.Hello", "grpc_endpoint")]


def test_socket_hubs(make_graph, spark):
    g = make_graph(
        [
            {"fqn": "H", "kind": "CLASS", "name": "ChatHub", "base_class": "Hub<IClient>"}, {"fqn": "H.Send", "kind": "FUNCTION"}, {"fqn": "H.OnConnectedAsync", "kind": "FUNCTION"},
            {"fqn": "IClient", "kind": "INTERFACE"}, {"fqn": "IClient.Got", "kind": "FUNCTION"},
        ],
        [("H", "H.Send", "CONTAINS"), ("H", "H.OnConnectedAsync", "CONTAINS"), ("IClient", "IClient.Got", "CONTAINS")],
    )
    out = endpoints.socket_hubs(g, spark.createDataFrame([("ChatHub", "/chat")], "name string, url string"))
    assert got(out.edges, "src", "dst", "kind") == [("H", "endpoint:WS:/chat", "EXPOSES"), ("H", "endpoint:WS:/chat", "PRODUCES"), ("H.Send", "endpoint:WS:/chat", "HANDLES")]


def test_minimal_endpoints(spark):
    groups = spark.createDataFrame([("g", "/api")], "group_name string, prefix string")
    calls = spark.createDataFrame([("P", "P.a", "GET", "{id:int}", "g"), ("P", "P.b", "POST", "/x", None)], "owner string, handler string, verb string, path string, group_name string")
    out = endpoints.mapped_handlers(groups, calls)
    assert got(out.nodes, "fqn") == [("endpoint:GET:/api/:id",), ("endpoint:POST:/x",)]


def test_schema_history(spark):
    files = spark.createDataFrame(
        [
            ("V1__create_users.sql", "CREATE TABLE users (id BIGINT PRIMARY KEY, name VARCHAR(50) NOT NULL, email TEXT, created_at TIMESTAMP);"),
            ("V2__create_orders.sql", "CREATE TABLE orders (id BIGINT PRIMARY KEY, user_id BIGINT, total DECIMAL(10,2), status TEXT, created_at TIMESTAMP,\n FOREIGN KEY (user_id) REFERENCES users (id));"),
            ("V10__later.sql", "ALTER TABLE users ADD COLUMN phone VARCHAR(30);"), ("V3__index.sql", "ALTER TABLE users ADD phone TEXT; CREATE INDEX idx ON users (email);"), ("R__skip.sql", "DROP TABLE users;"),
        ],
        "name string, text string",
    )
    columns, references, indexes = schema_history.fold_schema(schema_history.statements(files))
    assert sorted(r["column"] for r in columns.filter("table = 'users'").collect()) == ["created_at", "email", "id", "name", "phone"]
    assert columns.filter("table = 'orders'").count() == 5
    assert columns.filter("column = 'phone'").first()["type"] == "VARCHAR(30)"
    graph = schema_history.schema_graph(columns, references)
    assert got(graph.edges.filter("kind = 'REFERENCES'"), "src", "dst") == [("table:orders.user_id", "table:users.id")]
    assert got(indexes, "index", "table", "column", "is_unique") == [("idx", "users", "email", False)]


def test_model_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("list[A]",), ("Optional[B]",), ("Union[C, None]",), ("D | None",), ("E",)], "v string")
    assert [r[0] for r in df.select(mapping.model_name(F.col("v"))).collect()] == list("ABCDE")
