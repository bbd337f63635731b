"""Language rules: suffixes and extraction patterns per language.

Every pattern is written once here and used by both the Spark jobs (Java
regex) and the DuckDB oracle (RE2).  To behave the same in both dialects the
patterns avoid look-around and back-references, escape ``{``, use ``[^\\n]``
instead of ``.`` and write flags inline.  ``\\w`` is ASCII in both engines.

``LanguageRules`` is the extension point (U1): register a language with its
suffixes and patterns and every extraction job covers it, because the jobs
build one literal ``CASE language`` branch per registered language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the analysed tool's constants for equal results.
# Patterns carry the documented fixes (see README "Deviations"): Python
# functions accept a return annotation, Python imports stay on one line, line
# comments stop at the newline, C/C++/Java braces are escaped for Java regex.
# ---------------------------------------------------------------------------

SUFFIX_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "javascript",
    ".tsx": "typescript",
    ".java": "java",
    ".cpp": "cpp",
    ".c": "c",
    ".go": "go",
    ".rs": "rust",
    ".php": "php",
    ".rb": "ruby",
    ".swift": "swift",
    ".kt": "kotlin",
}

MAX_FILE_BYTES = 50000
MAX_FILES_PER_REPO = 100

FUNCTION_PATTERNS = {
    "python": r"def\s+(\w+)\s*\([^)]*\)(?:\s*->[^:]*)?:",
    "javascript": r"(?:function\s+(\w+)\s*\(|(?:const|let|var)\s+(\w+)\s*=\s*(?:function|\([^)]*\)\s*=>))",
    "typescript": r"(?:function\s+(\w+)\s*\(|(?:const|let|var)\s+(\w+)\s*:\s*[^=]*=\s*(?:function|\([^)]*\)\s*=>))",
    "java": r"(?:public|private|protected)?\s*(?:static)?\s*(?:final)?\s*\w+\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+(?:,\s*\w+)*)?\s*\{",
    "cpp": r"(?:[\w:]+\s+)?(\w+)\s*\([^)]*\)\s*(?:const)?\s*\{",
    "c": r"(?:[\w\s*]+\s+)?(\w+)\s*\([^)]*\)\s*\{",
    "go": r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\([^)]*\)",
    "rust": r"fn\s+(\w+)\s*\([^)]*\)",
    "php": r"(?:public|private|protected)?\s*(?:static)?\s*function\s+(\w+)\s*\(",
    "ruby": r"def\s+(\w+)\s*(?:\([^)]*\))?",
    "swift": r"func\s+(\w+)\s*\([^)]*\)",
    "kotlin": r"(?:fun\s+(\w+)\s*\(|(?:public|private|protected)?\s*fun\s+(\w+)\s*\()",
}

CLASS_PATTERNS = {
    "python": r"class\s+(\w+)\s*(?:\([^)]*\))?:",
    "javascript": r"class\s+(\w+)(?:\s+extends\s+\w+)?",
    "typescript": r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?",
    "java": r"(?:public|private|protected)?\s*(?:abstract|final)?\s*class\s+(\w+)(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?",
    "cpp": r"class\s+(\w+)(?:\s*:\s*(?:public|private|protected)\s+\w+)?",
    "c": r"(?:typedef\s+)?struct\s+(\w+)",
    "go": r"type\s+(\w+)\s+struct",
    "rust": r"(?:pub\s+)?struct\s+(\w+)",
    "php": r"(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+\w+)?",
    "ruby": r"class\s+(\w+)(?:\s*<\s*\w+)?",
    "swift": r"(?:public|private|internal)?\s*(?:final\s+)?class\s+(\w+)(?:\s*:\s*[\w,\s]+)?",
    "kotlin": r"(?:open|final|abstract)?\s*class\s+(\w+)(?:\s*:\s*[\w,\s()]+)?",
}

IMPORT_PATTERNS = {
    "python": r"(?:from[ \t]+[\w.]+[ \t]+)?import[ \t]+[\w.,*( \t]+",
    "javascript": r"""import\s+[^\n]*?from\s+['"][^'"]+['"]|require\(['"][^'"]+['"]\)""",
    "typescript": r"""import\s+[^\n]*?from\s+['"][^'"]+['"]""",
    "java": r"import\s+(?:static\s+)?[\w.]+(?:\.\*)?;",
    "cpp": r"""#include\s*[<"][^>"]+[>"]""",
    "c": r"""#include\s*[<"][^>"]+[>"]""",
    "go": r"""import\s+(?:\(\s*)?['"][^'"]+['"](?:\s*\))?""",
    "rust": r"use\s+[\w:]+(?:\s*as\s+\w+)?;",
    "php": r"""(?:require|include)(?:_once)?\s+['"][^'"]+['"];|use\s+[\w\\]+(?:\s+as\s+\w+)?;""",
    "ruby": r"""require\s+['"][^'"]+['"]""",
    "swift": r"import\s+\w+",
    "kotlin": r"import\s+[\w.]+(?:\.\*)?",
}

_SLASH_COMMENTS = r"//[^\n]*|/\*[\s\S]*?\*/"
COMMENT_PATTERNS = {
    "python": r"#[^\n]*",
    "javascript": _SLASH_COMMENTS,
    "typescript": _SLASH_COMMENTS,
    "java": _SLASH_COMMENTS,
    "cpp": _SLASH_COMMENTS,
    "c": _SLASH_COMMENTS,
    "go": _SLASH_COMMENTS,
    "rust": _SLASH_COMMENTS,
    "php": _SLASH_COMMENTS + r"|#[^\n]*",
    "ruby": r"#[^\n]*",
    "swift": _SLASH_COMMENTS,
    "kotlin": _SLASH_COMMENTS,
}

VARIABLE_PATTERNS = {
    "python": r"(\w+)\s*=",
    "javascript": r"(?:const|let|var)\s+(\w+)",
    "typescript": r"(?:const|let|var)\s+(\w+)",
    "java": r"(?:public|private|protected)?\s*(?:static)?\s*(?:final)?\s*\w+\s+(\w+)\s*[=;]",
    "cpp": r"(?:int|float|double|char|string|bool|auto)\s+(\w+)",
    "go": r"(?:var\s+(\w+)|(\w+)\s*:=)",
    "rust": r"let\s+(?:mut\s+)?(\w+)",
}

PYTHON_METHOD_PATTERN = r"def\s+(\w+)\s*\("
DOCSTRING_PATTERN = r'"""([\s\S]*?)"""|' + r"'''([\s\S]*?)'''"
# The same matches for Java alone (RE2 has no possessive quantifiers): up to the first three quotes in a row by whole
# stretches without a quote, where the lazy pattern tries its end at every character.
DOCSTRING_SCAN = r'"""[^"]*+(?:"{1,2}+[^"]++)*+"""|' + r"'''[^']*+(?:'{1,2}+[^']++)*+'''"
DOC_BLOCK_PATTERN = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|/\*\*[\s\S]*?\*/"

CONTROL_KEYWORDS = ["if", "for", "while", "switch", "case", "try", "catch", "except", "elif", "else"]
# Names that the function patterns of these languages pick up from control statements; elsewhere they are names.
NOT_FUNCTION_NAMES = CONTROL_KEYWORDS + ["return", "new"]
CONTROL_NAME_LANGUAGES = ["c", "cpp", "java"]

IMPORT_CAP = 20
COMMENT_CAP = 10
VARIABLE_CAP = 15
DOCSTRING_CAP = 5
METHOD_CAP = 5
BODY_PREVIEW_CHARS = 200

ENTRY_POINT_WORDS = ["main", "index", "app", "server"]
TEST_PATH_WORDS = ["test", "spec"]
TEST_CONTENT_WORDS = ["test", "spec", "assert"]

MVC_INDICATORS = ["model", "view", "controller", "routes", "handlers"]
LAYERED_INDICATORS = ["service", "repository", "dao", "controller", "business", "domain"]
MICROSERVICE_INDICATORS = ["service", "api", "gateway", "config", "docker"]
MONOLITH_MIN_FILES = 20

EXTERNAL_LIBRARIES = [
    "numpy", "pandas", "requests", "flask", "django", "react", "express",
    "lodash", "axios", "moment", "jquery", "bootstrap", "tensorflow",
    "pytorch", "opencv", "matplotlib", "spring", "hibernate",
]

IMPORTANT_PATH_WORDS = ["main", "index", "app", "server", "core"]
CONFIG_PATH_WORDS = ["config", "settings", "setup"]

RECOMMENDATIONS = [
    "Consider breaking down large code blocks into functions for better modularity",
    "Many files have low maintainability - consider refactoring complex functions",
    "Add more test coverage to improve code reliability",
    "Consider adding clear entry points (main functions) to your application",
    "Multiple languages detected - ensure consistency in coding standards",
]

NO_ANSWER_TEXT = "I couldn't find relevant information to answer your question in the codebase."
ANSWER_HEADER = "Based on the codebase analysis, here are the most relevant findings for your question:\n\n"
ANSWER_PROMPT_TEMPLATE = (
    "\nYou are a helpful code documentation assistant. Answer the user's question based on the provided context "
    "from the codebase analysis.\n\nPROJECT CONTEXT:\n{project_context}\n\nRELEVANT CONTEXT:\n{context}\n\n"
    "USER QUESTION: {question}\n\nPlease provide a clear, helpful answer based on the context. If the context doesn't "
    "contain enough information, say so clearly. Focus on being accurate and cite which sources you're referencing.\n"
)
NO_API_TEXT = "No public API functions or classes found for documentation."

# Python's str.strip()/str.isspace() whitespace, as one class for both dialects.
PY_WHITESPACE = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Python's \w for str patterns (letters and numbers of any script, and '_').
UNICODE_WORD = r"[\p{L}\p{N}_]"

# Document formats (text templates filled per file / repository).

FILE_DOC_TEMPLATE = (
    "# {path}\n\n**Language:** {language}\n\n## Overview\n"
    "This {language} file contains {n_functions} functions and {n_classes} classes.\n\n"
    "## Functions\n{function_lines}\n## Classes\n{class_lines}{dependencies}\n## Code Metrics\n"
    "- Total lines: {total_lines}\n- Code lines: {code_lines}\n- Estimated maintainability: {maintainability}\n\n"
    "*Note: This documentation was generated from code analysis only.*\n"
)
FILE_DOC_FUNCTION_LINE = "- `{name}` (line {line})\n"
NO_FUNCTIONS_LINE = "No functions found.\n"
NO_CLASSES_LINE = "No classes found.\n"
FILE_DOC_FUNCTIONS_CAP = 10
FILE_DOC_IMPORTS_CAP = 10

FILE_INDEX_TEMPLATE = (
    "# File Documentation Index\n\n"
    "This section contains detailed documentation for individual files in the project.\n\n"
    "## Documented Files\n\n{entries}\n\n---\n\n"
    "*File documentation generated automatically from code analysis.*\n"
    "*Total files documented: {n_files}*\n*Last updated: {generated_on}*\n"
)
FILE_INDEX_ENTRY = "- [{path}](files/{safe_name}.md)\n"

API_PAGE_TEMPLATE = (
    "# API Documentation\n\n{text}\n\n---\n\n"
    "*This API documentation was generated automatically from code analysis.*\n*Last updated: {generated_on}*\n"
)
SETUP_PAGE_TEMPLATE = (
    "# Setup Guide\n\n{text}\n\n## Additional Notes\n\n"
    "- Make sure all prerequisites are installed before proceeding\n- Check the main README for project overview\n"
    "- See API documentation for usage details\n\n---\n\n"
    "*This setup guide was generated automatically from project analysis.*\n*Last updated: {generated_on}*\n"
)
ARCHITECTURE_PAGE_TEMPLATE = (
    "# Architecture Overview\n\n{text}\n\n## Additional Analysis\n\n"
    "This document provides insights into the project's structure, patterns, and design decisions based on automated "
    "code analysis.\n\n---\n\n*This architecture documentation was generated automatically.*\n"
    "*Last updated: {generated_on}*\n"
)
FILE_PAGE_TEMPLATE = (
    "# {path}\n\n{text}\n\n---\n\n*File documentation generated automatically from code analysis.*\n"
    "*Last updated: {generated_on}*\n\n[← Back to File Index](../FILES.md)\n"
)
SETUP_TEXT_TEMPLATE = "Languages: {languages}\nDependencies: {dependencies}\nEntry points: {entry_points}"

FILE_PROMPT_TEMPLATE = (
    "\nGenerate comprehensive documentation for this code file:\n\n"
    "**FILE**: {path}\n**LANGUAGE**: {language}\n\n"
    "**FUNCTIONS** ({n_functions} total):\n{functions_summary}\n\n"
    "**CLASSES** ({n_classes} total):\n{classes_summary}\n\n"
    "**KEY IMPORTS**:\n{imports}\n\n"
    "**COMPLEXITY METRICS**:\n- Lines of code: {code_lines}\n- Cyclomatic complexity: {complexity}\n"
    "- Maintainability: {maintainability}\n\n"
    "**REQUIREMENTS**:\nGenerate documentation including:\n"
    "1. **Purpose**: What this file does and its role in the project\n"
    "2. **Key Components**: Main functions and classes with their responsibilities\n"
    "3. **Dependencies**: Important imports and their purposes\n"
    "4. **Usage**: How this file is typically used or called\n"
    "5. **Notes**: Any important implementation details or patterns\n\n"
    "Keep it concise but comprehensive. Use markdown formatting.\n        "
)
PROMPT_FUNCTION_LINE = "- {name}: {signature}... ({lines} lines)"
PROMPT_CLASS_LINE = "- {name}: {methods} methods"
PROMPT_FUNCTIONS_CAP = 10
PROMPT_CLASSES_CAP = 5
PROMPT_IMPORTS_CAP = 10
PROMPT_SIGNATURE_CHARS = 100

DIGEST_FUNCTIONS_CAP = 5
DIGEST_CLASSES_CAP = 3
DIGEST_IMPORTS_CAP = 5
API_FUNCTIONS_CAP = 20
API_CLASSES_CAP = 10

API_PROMPT_TEMPLATE = (
    "\nGenerate API documentation for the following code elements:\n\n"
    "**FUNCTIONS** ({n_functions} shown):\n{functions_detail}\n\n"
    "**CLASSES** ({n_classes} shown):\n{classes_detail}\n\n"
    "**REQUIREMENTS**:\nGenerate API documentation including:\n"
    "1. **Function Reference**: Each function with parameters, return values, and purpose\n"
    "2. **Class Reference**: Each class with methods and attributes\n"
    "3. **Usage Examples**: Basic code examples where helpful\n"
    "4. **Parameter Details**: Types and descriptions where inferrable\n"
    "5. **Return Values**: What each function/method returns\n\n"
    "Use markdown formatting with clear sections. Focus on public/main functions and classes.\n        "
)
API_FUNCTION_BLOCK = "**{name}**\n- Signature: `{signature}`\n- Preview: {preview}..."
API_CLASS_BLOCK = "**{name}**\n- Declaration: `{signature}`\n- Methods: {methods}"
API_PREVIEW_CHARS = 150

SUMMARY_TEMPLATE = (
    "# Project Analysis Summary\n\n## Code Statistics\n- **Total Files**: {total_files}\n"
    "- **Languages**: {languages}\n- **Functions**: {functions}\n- **Classes**: {classes}\n\n"
    "## Architecture Patterns\n{patterns}\n\n## Code Quality\n- **Test Coverage**: {coverage}\n"
    "- **Entry Points**: {entry_points}\n- **Complexity Distribution**: {distribution}\n\n"
    "## Recommendations\n{recommendations}\n\n---\n*Analysis completed on: {generated_on}*\n"
)
NO_PATTERNS_LINE = "- No specific patterns detected"

OVERVIEW_PROMPT_TEMPLATE = (
    "\nGenerate a comprehensive project overview for this codebase:\n\n"
    "**PROJECT**: {name}\n**DESCRIPTION**: {description}\n\n"
    "**CODE STATISTICS**:\n- Total files: {total_files}\n- Languages: {languages}\n- Functions: {functions}\n"
    "- Classes: {classes}\n- External dependencies: {n_dependencies}\n\n"
    "**ARCHITECTURE ANALYSIS**:\n- Detected patterns: {patterns}\n- Entry points: {entry_points}\n"
    "- Test coverage: {coverage}\n\n"
    "**RECOMMENDATIONS**:\n{recommendations}\n\n"
    "**REQUIREMENTS**:\nGenerate documentation including:\n"
    "1. **Project Overview**: Purpose and main functionality\n"
    "2. **Architecture**: Overall structure and design patterns\n"
    "3. **Technology Stack**: Languages, frameworks, and key dependencies\n"
    "4. **Project Structure**: Directory organization and key modules\n"
    "5. **Getting Started**: Basic setup and usage instructions\n"
    "6. **Development Notes**: Important patterns or conventions used\n\n"
    "Use markdown formatting with clear sections and headers.\n        "
)
SETUP_PROMPT_TEMPLATE = (
    "\nGenerate a setup and installation guide for this project:\n\n"
    "**LANGUAGES USED**: {languages}\n**EXTERNAL DEPENDENCIES**: {dependencies}\n**ENTRY POINTS**: {entry_points}\n\n"
    "**REQUIREMENTS**:\nGenerate a setup guide including:\n"
    "1. **Prerequisites**: Required software and versions\n"
    "2. **Installation**: Step-by-step installation instructions\n"
    "3. **Configuration**: Any required configuration steps\n"
    "4. **Running the Project**: How to start/run the application\n"
    "5. **Development Setup**: Additional steps for development\n"
    "6. **Troubleshooting**: Common issues and solutions\n\n"
    "Use markdown formatting with clear step-by-step instructions.\n        "
)
NO_DESCRIPTION = "No description available"
PROMPT_ENTRY_POINTS_CAP = 20

README_TEMPLATE = (
    "# {name}\n\n{description}\n\n## Overview\n\n{overview}...\n\n## Quick Stats\n\n"
    "- **Languages**: {languages}\n- **Files**: {files} analyzed\n- **Functions**: {functions}\n"
    "- **Classes**: {classes}\n\n## Documentation\n\n"
    "- 📚 [Setup Guide](docs/SETUP.md) - Installation and configuration\n"
    "- 🏗️ [Architecture](docs/ARCHITECTURE.md) - Project structure and design\n"
    "- 🔧 [API Reference](docs/API.md) - Functions and classes\n"
    "- 📁 [File Documentation](docs/FILES.md) - Individual file details\n\n"
    "## Getting Started\n\nSee the [Setup Guide](docs/SETUP.md) for detailed installation instructions.\n\n"
    "## Project Structure\n\n```\n{tree}\n```\n\n---\n\n"
    "*Documentation generated automatically from code analysis*\n*Generated on: {generated_on}*\n"
)
README_DESCRIPTION = "A software project"
README_OVERVIEW_CHARS = 500
TREE_FILES_CAP = 20
TREE_BRANCH, TREE_LAST, TREE_PIPE, TREE_SPACE = "├── ", "└── ", "│   ", "    "

# ---------------------------------------------------------------------------


@dataclass
class LanguageRules:
    """Registry of languages and their extraction patterns."""

    suffixes: dict[str, str] = field(default_factory=lambda: dict(SUFFIX_LANGUAGE))
    functions: dict[str, str] = field(default_factory=lambda: dict(FUNCTION_PATTERNS))
    classes: dict[str, str] = field(default_factory=lambda: dict(CLASS_PATTERNS))
    imports: dict[str, str] = field(default_factory=lambda: dict(IMPORT_PATTERNS))
    comments: dict[str, str] = field(default_factory=lambda: dict(COMMENT_PATTERNS))
    variables: dict[str, str] = field(default_factory=lambda: dict(VARIABLE_PATTERNS))
    methods: dict[str, str] = field(default_factory=lambda: {"python": PYTHON_METHOD_PATTERN})

    def register(self, language: str, suffixes: list[str], *, function: str | None = None,
                 klass: str | None = None, imports: str | None = None,
                 comment: str | None = None, variable: str | None = None,
                 method: str | None = None) -> "LanguageRules":
        """Add or replace a language; patterns are validated before use."""
        for s in suffixes:
            self.suffixes[s] = language
        for table, pattern, named in ((self.functions, function, True), (self.classes, klass, True),
                                      (self.imports, imports, False), (self.comments, comment, False),
                                      (self.variables, variable, True), (self.methods, method, True)):
            if pattern is not None:
                validate_pattern(pattern, named)
                table[language] = pattern
        return self

    def method_pattern(self, language: str) -> str | None:
        return self.methods.get(language) or self.functions.get(language)


_FORBIDDEN = re.compile(r"\(\?<?[=!]|\\[1-9]")


def validate_pattern(pattern: str, named: bool = False) -> None:
    """Reject what one of the two regex dialects lacks, what doesn't compile (in Java too, where a session runs), what
    matches empty text (positions are sums over matches and the text between them), and a ``named`` pattern without a
    group for the name."""
    if _FORBIDDEN.search(pattern):
        raise ValueError(f"look-around and back-references are not portable: {pattern!r}")
    if re.search(r"(?<!\\)\{(?!\d)", pattern):
        raise ValueError(f"escape literal '{{' as '\\{{': {pattern!r}")
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a pattern: {pattern!r}: {e}") from e
    if re.search(r"\(\?(?:P|\(|[aLu])|\\Z", pattern):
        raise ValueError(f"Python syntax that Java doesn't have: {pattern!r}")
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        except Py4JJavaError as e:
            raise ValueError(f"not a pattern in Java: {pattern!r}: {e.java_exception.getMessage()}") from e
    if any(m.end() == m.start() for m in compiled.finditer("a (b) {c} 1 = 'd'; // e\n# f\n")) or compiled.match(""):
        raise ValueError(f"matches empty text: {pattern!r}")
    if named and not 1 <= compiled.groups <= 2:
        raise ValueError(f"one or two groups must hold the name: {pattern!r}")


DEFAULT_RULES = LanguageRules()
