"""Classifiers of prompts, commands, paths and tools, as ordered tables of regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.scalar import half_up

# Weight, label and patterns of each category of the prompt score.
COMPLEXITY = [
    (2.0, "implementation task", [r"\b(implement|integrate|build|create|design|architect|develop)\b", r"\b(refactor|migrate|overhaul|rewrite|restructure)\b", r"\b(set\s*up|configure|deploy|provision)\b"]),
    (2.0, "external integration", [r"\b(api|sdk|oauth|auth0|firebase|supabase|stripe|twilio)\b", r"\b(aws|gcp|azure|cloudflare|vercel|netlify)\b", r"\b(statsig|launchdarkly|posthog|amplitude|segment)\b", r"\b(database|redis|postgres|mongodb|mysql|sqlite)\b", r"\b(docker|kubernetes|k8s|terraform|pulumi)\b"]),
    (1.5, "broad scope", [r"\b(entire|whole|all\s+files?|across|throughout)\b", r"\b(codebase|project|application|system)\b", r"\b(every|each)\s+(file|component|module|service)\b"]),
    (1.0, "multi-step", [r"\b(first|then|after\s+that|next|finally|step\s*\d+)\b", r"\b(and\s+also|as\s+well\s+as|in\s+addition)\b", r"\d+\.\s+\w", r"[-*]\s+\w.*\n[-*]\s+\w"]),
    (1.5, "technical complexity", [r"\b(authentication|authorization|security|encryption|jwt|session)\b", r"\b(migration|schema|model|entity|relationship)\b", r"\b(real-?time|websocket|sse|streaming|polling)\b", r"\b(cache|caching|memoiz|optimization|performance)\b", r"\b(concurrent|parallel|async|queue|worker|job)\b", r"\b(test|testing|coverage|e2e|integration\s+test)\b"]),
    (0.5, "requires exploration", [r"\b(how\s+(should|do|can|would)|what('?s|\s+is)\s+the\s+best)\b", r"\b(recommend|suggest|advice|opinion)\b", r"\b(not\s+sure|unclear|don'?t\s+know)\b"]),
    (2.0, "explicitly complex", [r"\b(complex|complicated|difficult|challenging|non-?trivial)\b", r"\b(major|significant|substantial|extensive)\b"]),
    (-2.0, "simple task", [r"\b(fix\s+typo|rename|add\s+comment|update\s+readme)\b", r"\b(simple|quick|small|minor|trivial)\b", r"\b(just|only|single)\s+(one|a|1)\b"]),
    (-3.0, "informational query", [r"\b(what\s+is|explain|describe|show\s+me|list)\b", r"\b(where\s+is|find|locate|search\s+for)\b", r"\b(how\s+does|why\s+does|what\s+does)\b"]),
]

# Package commands, the group that holds the packages, and the ecosystem.
PACKAGES = [
    (r"(?i)^(npm|yarn|pnpm)\s+(install|add|i)\s+(.+)", 3, "npm"),
    (r"(?i)^bun\s+(add|install)\s+(.+)", 2, "npm"),
    (r"(?i)^pip\s+install\s+(.+)", 1, "pip"),
    (r"(?i)^pip3\s+install\s+(.+)", 1, "pip"),
    (r"(?i)^cargo\s+add\s+(.+)", 1, "cargo"),
    (r"(?i)^go\s+get\s+(.+)", 1, "go"),
]

# Categories of sensitive paths, in order.
SENSITIVE = [
    ("Environment files", [r"\.env$", r"\.env\.\w+$", r"\.env\.local$", r"\.env\.production$", r"\.env\.development$"]),
    ("Keys & Certificates", [r"\.pem$", r"\.key$", r"\.p12$", r"\.pfx$", r"\.crt$", "id_rsa", "id_ed25519", "id_ecdsa", "id_dsa", r"\.ppk$"]),
    ("Secret directories", ["/secrets?/", "/credentials?/", r"/\.ssh/", "/private/"]),
    ("Config files", ["/config/production", r"\.credentials$", r"\.netrc$", r"\.npmrc$", r"\.pypirc$"]),
    ("Password/Token files", [r"passwords?\.[\w]+$", r"tokens?\.[\w]+$", r"api[_-]?keys?\.[\w]+$", r"secrets?\.[\w]+$", r"auth\.[\w]+$"]),
    ("Cloud credentials", [r"\.aws/credentials", r"\.aws/config", r"\.gcloud/", r"\.azure/", r"\.kube/config", "kubeconfig"]),
]

# What tells a documentation lookup.
DOCS = [r"docs?\.", "documentation", r"api[.\-_]?reference", "official.*docs?", r"how\s+to\s+use.*(?:library|package|framework|module)", r"getting\s+started.*(?:with|guide)", r"(?:read|check|see).*(?:the\s+)?docs?"]

# Library names and their patterns, in order; a name alone is its own pattern.
LIBRARIES = [
    ("react", "react|reactjs"), ("vue", r"vue|vuejs|vue\.js"), ("angular", "angular"), ("svelte", "svelte|sveltekit"), ("next.js", r"next|nextjs|next\.js"), ("nuxt", "nuxt|nuxtjs"), ("remix", "remix"), ("astro", "astro"), ("solid", "solid|solidjs"),
    ("bun", "bun"), ("deno", "deno"), ("node.js", r"node|nodejs|node\.js"),
    ("express", "express|expressjs"), ("fastify", "fastify"), ("hono", "hono"), ("elysia", "elysia"), ("koa", "koa"), ("nestjs", "nestjs|nest"),
    ("tailwindcss", "tailwind|tailwindcss"), ("shadcn", "shadcn"), ("radix", "radix"), ("chakra-ui", "chakra"), ("material-ui", "mui|material.?ui"),
    ("prisma", "prisma"), ("drizzle", "drizzle"), ("kysely", "kysely"), ("typeorm", "typeorm"), ("sequelize", "sequelize"), ("mongoose", "mongoose"), ("supabase", "supabase"),
    ("zod", "zod"), ("yup", "yup"), ("joi", "joi"), ("valibot", "valibot"),
    ("vitest", "vitest"), ("jest", "jest"), ("playwright", "playwright"), ("cypress", "cypress"), ("testing-library", "testing.?library"),
    ("zustand", "zustand"), ("redux", "redux"), ("jotai", "jotai"), ("recoil", "recoil"), ("mobx", "mobx"),
    ("axios", "axios"), ("tanstack-query", "tanstack|react.?query"), ("trpc", "trpc"), ("graphql", "graphql"), ("apollo", "apollo"),
    ("auth.js", r"auth\.?js|next.?auth"), ("clerk", "clerk"), ("lucia", "lucia"),
    ("vite", "vite"), ("webpack", "webpack"), ("esbuild", "esbuild"), ("rollup", "rollup"), ("turbo", "turbopack|turborepo"),
    ("fastapi", "fastapi"), ("django", "django"), ("flask", "flask"), ("pydantic", "pydantic"), ("pandas", "pandas"), ("numpy", "numpy"), ("pytorch", "pytorch|torch"), ("tensorflow", "tensorflow"),
    ("tokio", "tokio"), ("axum", "axum"), ("actix", "actix"), ("serde", "serde"),
    ("gin", "gin"), ("echo", "echo"), ("fiber", "fiber"),
    ("docker", "docker"), ("kubernetes", "kubernetes|k8s"), ("terraform", "terraform"), ("pulumi", "pulumi"),
    ("langchain", "langchain"), ("openai", "openai"), ("anthropic", "anthropic"), ("vercel-ai", r"vercel.?ai|ai.?sdk"),
]

# Fixed value: words that are no topic.
TOPIC_WORDS = r"(?i)\b(docs?|documentation|api|reference|guide|tutorial|how\s+to|getting\s+started)\b"


def any_of(patterns: list[str]) -> str:
    return "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


BLANK = r"[\t\n\f\r ]"
_ASCII = {r"\b": r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))", r"\s": BLANK, r"\w": r"[\w\u017F\u212A]", ".": r"[^\n]", "k": r"[k\u212A]", "s": r"[s\u017F]"}


def ascii_rules(pattern: str) -> str:
    """A ``(?i)`` pattern by the rules of RE2: ``\\b`` knows ASCII words alone, so that a word may follow an accented letter;
    ``\\s`` has no vertical tab, a dot meets all but a line feed, and k and s meet the Kelvin sign and the long s too.

    Character classes stay as they are.
    """
    return re.sub(r"\(\?[a-z]*[:)]|\[(?:\\.|[^\\\]])*\]|\\.|[.ks]", lambda m: _ASCII.get(m[0], m[0]), pattern)


def end_only(pattern: str) -> str:
    """``$`` as the very end; elsewhere it may stand before a last line break too."""
    return pattern[:-1] + r"\z" if pattern.endswith("$") else pattern


def prompt_factors(prompt: Column) -> Column:
    """The labels of a prompt's categories, in order."""
    found = [F.when(prompt.rlike(ascii_rules(any_of(patterns))), F.lit(label)) for _, label, patterns in COMPLEXITY]
    return F.array_compact(F.array(*found, F.when(word_count(prompt) > 100, F.lit("detailed prompt")), F.when(sentence_count(prompt) >= 4, F.lit("multi-part request"))))


def word_count(prompt: Column) -> Column:
    return F.size(F.split(prompt, BLANK + "+"))


def sentence_count(prompt: Column) -> Column:
    return F.size(F.filter(F.split(prompt, "[.!?]+"), lambda s: F.length(F.regexp_replace(s, rf"\A{BLANK}+|{BLANK}+\z", "")) > 10))


def prompt_complexity(prompt: Column) -> Column:
    """1 to 10: a base of 3, the weight of each category met, and one each for many words and sentences."""
    total = F.lit(3.0)
    for weight, _, patterns in COMPLEXITY:
        total = total + F.when(prompt.rlike(ascii_rules(any_of(patterns))), weight).otherwise(0.0)
    total = total + F.when(word_count(prompt) > 100, 1.0).otherwise(0.0) + F.when(sentence_count(prompt) >= 4, 1.0).otherwise(0.0)
    return F.greatest(F.lit(1), F.least(F.lit(10), half_up(total, 0).cast("int")))


def prompt_reasoning(prompt: Column) -> Column:
    factors = prompt_factors(prompt)
    return F.when(F.size(factors) > 0, F.array_join(F.slice(factors, 1, 3), ", ")).otherwise("standard task")


def command_packages(command: Column) -> Column:
    """struct(ecosystem, packages) of an install command: the first pattern that gives packages; null if none does."""
    out = F.lit(None).cast("struct<ecosystem:string,packages:array<string>>")
    for pattern, group, ecosystem in reversed(PACKAGES):
        words = F.filter(F.split(F.regexp_extract(command, pattern, group), r"\s+"), lambda w: (w != "") & ~w.startswith("-"))
        names = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"@[\d.^~>=<]+.*$", "")), lambda w: w != "")
        out = F.when(command.rlike(pattern) & (F.size(names) > 0), F.struct(F.lit(ecosystem).alias("ecosystem"), names.alias("packages"))).otherwise(out)
    return out


def commit_system(command: Column) -> Column:
    return F.when(command.rlike(r"^\s*git\s+commit\b"), F.lit("git")).when(command.rlike(r"^\s*jj\s+(commit|describe|new)\b"), F.lit("jj"))


def sensitive_category(path: Column, allowed: list[str] = (), custom: list[str] = (), off: list[str] = ()) -> Column:
    """The first category whose pattern the path meets; null if none does or the path is allowed."""
    name = F.element_at(F.split(path, "/"), -1)
    free = F.lit(False)
    for a in allowed:
        free = free | (path.contains(a) if "/" in a else (name == a) | path.endswith(a))
    out = F.when(free, F.lit(None).cast("string"))
    for category, patterns in SENSITIVE:
        if category not in off:
            out = out.when(path.rlike(any_of([end_only(p) for p in patterns])), F.lit(category))
    for pattern in custom:
        out = out.when(path.rlike("(?i)" + pattern), F.lit("Custom pattern"))
    return out


def is_doc_query(text: Column) -> Column:
    return text.rlike(ascii_rules(any_of(DOCS)))


def libraries_in(text: Column) -> Column:
    """The libraries that a text names, in the table's order; one pass over the text finds out whether there is any."""
    found = F.array_compact(F.array(*[F.when(text.rlike(ascii_rules(rf"(?i)\b({p})\b")), F.lit(name)) for name, p in LIBRARIES]))
    some = "|".join(f"(?:{p})" for _, p in LIBRARIES)
    return F.when(text.rlike(ascii_rules(rf"(?i)\b(?:{some})\b")), found).otherwise(F.array().cast("array<string>"))


def topic_of(text: Column, libraries: Column) -> Column:
    known = F.create_map(*[F.lit(x) for name, _ in LIBRARIES for x in (name, ascii_rules(name))])
    edge = F.lit(_ASCII[r"\b"])
    bare = F.aggregate(libraries, text, lambda acc, name: F.regexp_replace(acc, F.concat(F.lit("(?i)"), edge, F.coalesce(F.try_element_at(known, name), name), edge), F.lit("")))
    topic = F.trim(F.regexp_replace(F.regexp_replace(bare, ascii_rules(TOPIC_WORDS), ""), BLANK + "+", " "))
    return F.when(topic == "", F.lit("general usage")).otherwise(topic)


def auto_approved(tool: Column, categories: dict[str, list[str]], enabled: list[str], never: list[str] = (), extra: list[str] = (), read_only: bool = True) -> Column:
    """Never-list, then extra list, then the master switch, then the enabled categories."""
    listed = [t for c in enabled for t in categories.get(c, [])]
    return F.when(tool.isin(list(never)), False).when(tool.isin(list(extra)), True).when(F.lit(not read_only), False).otherwise(tool.isin(listed))
