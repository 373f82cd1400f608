"""Source inventory: files, languages, lines, build tools, frameworks, dependencies.

File tables have the columns ``app_name, path, text`` (or ``content`` bytes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by
from graphlens.functions.text import count_loc
from graphlens.schema import literal_map

# Extension -> language.
LANGUAGES = {
    ".java": "java",
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".cs": "csharp",
    ".sql": "sql",
}

# Folders that hold no sources of their own.
SKIPPED_FOLDERS = [
    ".git", ".svn", ".hg", ".idea", ".vscode", ".settings", ".classpath", ".project",
    "node_modules", "target", "build", "dist", "bin", "obj", "__pycache__", ".gradle", ".mvn",
    "vendor", ".venv", "venv", ".tox", "packages",
]

# Build files as (pattern, tool, language, family, priority); the first of a family wins.
BUILD_FILES = [
    (r"^pom\.xml$", "maven", "java", "maven", 1),
    (r"^build\.gradle$", "gradle", "java", "gradle", 1),
    (r"^build\.gradle\.kts$", "gradle", "java", "gradle", 2),
    (r"^package\.json$", "npm", "javascript", "npm", 1),
    (r"^pyproject\.toml$", "uv/pip", "python", "python", 1),
    (r"^setup\.py$", "pip", "python", "python", 2),
    (r"^requirements\.txt$", "pip", "python", "python", 3),
    (r"\.csproj$", "dotnet", "csharp", "dotnet", 1),
    (r"\.sln$", "dotnet", "csharp", "dotnet", 2),
]

# Frameworks as (file kind, text looked for, ignore case, framework, language).
FRAMEWORK_TEXTS = [
    ("maven", "spring-boot", False, "spring-boot", "java"),
    ("maven", "hibernate", True, "hibernate", "java"),
    ("maven", "spring-data-jpa", False, "spring-data-jpa", "java"),
    ("maven", "spring-boot-starter-data-jpa", False, "spring-data-jpa", "java"),
    ("gradle", "spring-boot", False, "spring-boot", "java"),
    ("gradle", "hibernate", True, "hibernate", "java"),
    ("gradle", "spring-data-jpa", False, "spring-data-jpa", "java"),
    ("python", "django", True, "django", "python"),
    ("python", "fastapi", True, "fastapi", "python"),
    ("dotnet", "Microsoft.AspNetCore", False, "aspnet", "csharp"),
    ("dotnet", 'Sdk="Microsoft.NET.Sdk.Web"', False, "aspnet", "csharp"),
    ("dotnet", "Microsoft.EntityFrameworkCore", False, "efcore", "csharp"),
    ("dotnet", "EntityFramework", False, "efcore", "csharp"),
]
NPM_FRAMEWORKS = {
    "express": ("express", "javascript"),
    "react": ("react", "javascript"),
    "@nestjs/core": ("nestjs", "typescript"),
    "@angular/core": ("angular", "typescript"),
}


def read_tree(spark: SparkSession, root: str, app_name: str) -> DataFrame:
    """Every file below ``root`` with its path relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "")
    return files.select(F.lit(app_name).alias("app_name"), relative.alias("path"), "content", "length")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language_of(path: Column) -> Column:
    """Language by lower-cased extension; NULL for any other file."""
    return literal_map(LANGUAGES)[F.lower(F.regexp_extract(base_name(path), r"(?s).(\.[^.]*)$", 1))]


def in_skipped_folder(path: Column) -> Column:
    folders = F.split(path, "/")
    above = F.slice(folders, F.lit(1), F.size(folders) - 1)
    return F.exists(above, lambda s: s.startswith(".") | s.isin(*SKIPPED_FOLDERS))


def source_files(files: DataFrame) -> DataFrame:
    """Files in a known language outside hidden and generated folders."""
    return files.withColumn("language", language_of(F.col("path"))).filter(
        F.col("language").isNotNull() & ~in_skipped_folder(F.col("path"))
    )


def with_loc(files: DataFrame) -> DataFrame:
    return files.withColumn("loc", count_loc(F.col("text")))


def language_rollup(files: DataFrame) -> DataFrame:
    """(language, file_count, total_loc) of counted source files."""
    return files.groupBy("language").agg(F.count("*").alias("file_count"), F.sum("loc").alias("total_loc"))


def _config_files(files: DataFrame) -> DataFrame:
    """Build files at the root or one folder down, with tool, family and priority."""
    name = base_name(F.col("path"))
    depth = F.size(F.split("path", "/"))
    rule = F.lit(None).cast("int")
    for i in reversed(range(len(BUILD_FILES))):
        rule = F.when(name.rlike(BUILD_FILES[i][0]), i).otherwise(rule)

    def field(position):
        return literal_map({i: r[position] for i, r in enumerate(BUILD_FILES)})[F.col("rule")]

    return (
        files.withColumn("rule", rule).filter(F.col("rule").isNotNull())
        .withColumn("folder", F.when(depth == 1, ".").otherwise(F.substring_index("path", "/", 1)))
        .withColumn("depth", depth).withColumn("config_file", name)
        .withColumn("tool", field(1)).withColumn("language", field(2)).withColumn("family", field(3)).withColumn("priority", field(4))
    )


def build_tools(files: DataFrame) -> DataFrame:
    """(app_name, subproject_root, tool, language, config_file): one tool per folder and family."""
    near = _config_files(files).filter(F.col("depth") <= 2).filter(~in_skipped_folder(F.col("path")))
    best = first_by(near, ["app_name", "folder", "family"], ["priority", "config_file"], ["tool", "language", "config_file"])
    return best.select("app_name", F.col("folder").alias("subproject_root"), "tool", "language", "config_file")


def frameworks(files: DataFrame) -> DataFrame:
    """(app_name, framework, language) found in build files."""
    found = _config_files(files).select("app_name", "family", "text", "config_file")
    hits = F.array(*[
        F.when(
            (F.col("family") == family)
            & F.contains(F.lower("text") if fold else F.col("text"), F.lit(text)),
            F.struct(F.lit(name).alias("framework"), F.lit(language).alias("language")),
        )
        for family, text, fold, name, language in FRAMEWORK_TEXTS
    ])
    plain = found.filter("NOT config_file LIKE '%.sln'").select("app_name", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("f")).select("app_name", "f.*")
    packages = npm_dependencies(files).select("app_name", "name").distinct()
    npm = packages.select(
        "app_name", literal_map({k: v[0] for k, v in NPM_FRAMEWORKS.items()})[F.col("name")].alias("framework"),
        literal_map({k: v[1] for k, v in NPM_FRAMEWORKS.items()})[F.col("name")].alias("language"),
    ).filter("framework IS NOT NULL")
    return plain.unionByName(npm).distinct()


# --- dependencies ------------------------------------------------------------------------


def _named(files: DataFrame, pattern: str) -> DataFrame:
    return files.filter(base_name(F.col("path")).rlike(pattern)).select("app_name", "path", "text")


def _rows(df: DataFrame, language: str, name: Column, version: Column, scope: Column) -> DataFrame:
    empty = F.lit("")
    return df.select(
        "app_name", "path", F.lit(language).alias("language"), name.alias("name"), F.nullif(version, empty).alias("version"), scope.alias("scope")
    )


def maven_dependencies(files: DataFrame) -> DataFrame:
    text = F.regexp_replace("text", "(?s)<!--.*?-->", "")
    blocks = _named(files, r"^pom\.xml$").select(
        "app_name", "path", F.explode(F.regexp_extract_all(text, F.lit(r"(?s)<dependency>.*?</dependency>"), F.lit(0))).alias("block")
    )

    def tag(name):
        return F.trim(F.regexp_extract("block", f"<{name}>([^<]*)</{name}>", 1))

    whole = blocks.filter(F.contains("block", F.lit("<groupId>")) & F.contains("block", F.lit("<artifactId>")))
    scope = F.coalesce(F.nullif(tag("scope"), F.lit("")), F.lit("compile"))
    return _rows(whole, "java", F.concat_ws(":", tag("groupId"), tag("artifactId")), tag("version"), scope)


def gradle_dependencies(files: DataFrame) -> DataFrame:
    """Declared coordinates of gradle files, by pattern; scope from the configuration name."""
    # A configuration name, an opening parenthesis or none, and one quoted "group:name[:version][:classifier][@type]".
    configurations = "implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor"
    pattern = rf"""\b({configurations})\b\s*\(?\s*(["'])([^:"'\s]+):([^:"'\s]+)(?::([^:@"'\s]*)[^"'\n]*)?\2"""
    found = _named(files, r"^build\.gradle(\.kts)?$").select(
        "app_name", "path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("block")
    )

    def part(i):
        return F.trim(F.regexp_extract("block", pattern, i))

    scope = F.when(part(1).isin("testImplementation", "testRuntimeOnly"), "test").when(part(1) == "runtimeOnly", "runtime").otherwise("compile")
    return _rows(found, "java", F.concat_ws(":", part(3), part(4)), part(5), scope)


def npm_dependencies(files: DataFrame) -> DataFrame:
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    parsed = _named(files, r"^package\.json$").withColumn("p", F.from_json("text", schema))
    out = None
    for column, scope in (("dependencies", "compile"), ("devDependencies", "dev")):
        rows = parsed.select("app_name", "path", F.explode(f"p.{column}").alias("name", "version"))
        rows = _rows(rows, "javascript", F.col("name"), F.col("version"), F.lit(scope))
        out = rows if out is None else out.unionByName(rows)
    return out


#: A requirement: a name that begins and ends with a letter or digit, extras in brackets, and the rest.
REQUIREMENT = r"^([A-Za-z0-9](?:[\w.-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?(.*)$"


def _requirements(rows: DataFrame) -> DataFrame:
    line = F.trim("line")
    version = F.trim(F.regexp_replace(F.trim(F.regexp_extract(line, REQUIREMENT, 2)), "^==", ""))
    return _rows(rows.filter(line.rlike(REQUIREMENT)), "python", F.regexp_extract(line, REQUIREMENT, 1), version, F.lit("compile"))


def python_dependencies(files: DataFrame) -> DataFrame:
    """requirements.txt lines and the project dependency list of pyproject.toml."""
    lines = _named(files, r"^requirements\.txt$").select("app_name", "path", F.explode(F.split("text", r"\R")).alias("line"))
    lines = lines.filter(~F.trim("line").rlike("^(#|-|$)"))
    section = F.regexp_extract("text", r"(?s)(?:^|\n)\[project\]\s*\n(.*?)(?:\n\[|$)", 1)
    listed = F.regexp_extract(section, r"(?s)(?:^|\n)dependencies\s*=\s*\[(.*?)\]\s*(?:\n|$)", 1)
    quoted = F.transform(
        F.regexp_extract_all(listed, F.lit("""'[^']*'|"[^"]*\""""), F.lit(0)), lambda s: F.substring(s, F.lit(2), F.length(s) - 2)
    )
    project = _named(files, r"^pyproject\.toml$").select("app_name", "path", F.explode(quoted).alias("line"))
    return _requirements(lines.unionByName(project))


def dotnet_dependencies(files: DataFrame) -> DataFrame:
    text = F.regexp_replace("text", "(?s)<!--.*?-->", "")
    refs = _named(files, r"\.csproj$").select(
        "app_name", "path", F.explode(F.regexp_extract_all(text, F.lit(r"(?s)<PackageReference\b(?:[^>]*/>|.*?</PackageReference>)"), F.lit(0))).alias("block")
    )
    name = F.regexp_extract("block", r'\bInclude="([^"]*)"', 1)
    version = F.coalesce(
        F.nullif(F.regexp_extract("block", r'\bVersion="([^"]*)"', 1), F.lit("")), F.regexp_extract("block", r"<Version>([^<]*)</Version>", 1)
    )
    return _rows(refs.filter(name != ""), "csharp", name, version, F.lit("compile"))


def dependencies(files: DataFrame) -> DataFrame:
    """(app_name, path, language, name, version, scope) from every known build file."""
    parts = [f(files) for f in (maven_dependencies, gradle_dependencies, npm_dependencies, python_dependencies, dotnet_dependencies)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
