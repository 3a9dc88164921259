"""Framework routes and components."""

from __future__ import annotations

from graphloom.operators import frameworks as K
from graphloom.sources.tree import parse_source

PYTHON = """
import flask

@app.route("/home", methods=["POST", "GET"])
def home():
    pass

@router.get("/items/{id}")
async def item(id):
    pass

@bp.route("/plain")
@login_required
def plain():
    pass

@cached
def none():
    pass
"""


def test_python_routes(spark):
    found = parse_source("python", PYTHON)["functions"]
    functions = spark.createDataFrame([(f"function:a.py:{f['qualified_name']}", "a.py", f["qualified_name"], f["decorators"], f["http_method"], f["route_path"]) for f in found], "id string, file_path string, qualified_name string, decorators array<string>, http_method string, route_path string")
    routes = K.python_routes(functions)
    assert {tuple(r)[1:] for r in routes.collect()} == {("home", "flask", "POST", "/home"), ("item", "fastapi", "GET", "/items/{id}"), ("plain", "flask", None, "/plain")}
    assert {(r.id, r.layer, r.role, r.route_path) for r in K.tagged(functions, routes).collect()} == {("function:a.py:home", "api", "handler", "/home"), ("function:a.py:item", "api", "handler", "/items/{id}"), ("function:a.py:plain", "api", "handler", "/plain")}


def test_scripts(spark):
    files = [
        ("app/shop/[id]/route.ts", "typescript", "export async function GET(r) {}\nexport function POST() {}\nexport function get() {}"),
        ("app/page.tsx", "typescript", "'use client'\nexport default function Home() { const [a] = useState(0) }\nfunction useCart() {}"),
        ("lib/x.js", "javascript", "function plain() {}"),
        ("lib/y.js", "javascript", "import React from 'react'"),
        ("a.py", "python", "export function GET"),
    ]
    df = spark.createDataFrame(files, "path string, language string, text string")
    assert {tuple(r) for r in K.script_routes(df).collect()} == {("app/shop/[id]/route.ts", v, "nextjs", v, "/shop/[id]") for v in ("GET", "POST")}
    marks = {r.path: r for r in K.script_marks(df, spark.createDataFrame([("lib/y.js", "react")], "file_path string, module_path string")).collect()}
    assert set(marks) == {"app/shop/[id]/route.ts", "app/page.tsx", "lib/y.js"}
    page = marks["app/page.tsx"]
    assert (page.frameworks, page.components, page.hooks, page.is_page, page.is_client) == (["nextjs", "react"], ["Home"], ["useCart"], True, True)
    assert marks["lib/y.js"].frameworks == ["react"] and not marks["app/shop/[id]/route.ts"].is_page
