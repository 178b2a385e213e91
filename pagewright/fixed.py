"""Fixed values.

Every constant in this module must equal the behaviour being reproduced
(word lists, rule tables, prices, selectors, limits, prompts). They are
stated plainly and in their natural order; nothing here is derived.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — token budget
# ---------------------------------------------------------------------------
DEFAULT_MAX_TOKENS = 20000
STOP_FRACTION = 0.98          # stop once used >= 0.98 * max
WARNING_REMAINING = 0.85      # warn when remaining capacity <= 0.85
MIN_TOKENS_PER_PAGE = 1000    # floor of the per-page average in batch sizing
MAX_BATCH = 3                 # pages per batch, at most
SEED_SCORE = 100              # score of the seed URL
SEED_TYPE = "essential"       # type of the seed URL
BOOST_PER_SECTION = 5         # boost per missing required section matched

# ---------------------------------------------------------------------------
# FIXED VALUES — default priority rules, in rule order (first match wins)
# (section, patterns, score, required)
# ---------------------------------------------------------------------------
DEFAULT_RULES = [
    ("essential", ["introduction", "getting-started", "overview"], 100, True),
    ("core_concepts", ["concepts", "architecture", "lifecycle"], 80, True),
    ("features", ["features", "components", "routing"], 70, False),
    ("api", ["api", "reference"], 60, False),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — model prices, USD per token
# ---------------------------------------------------------------------------
MODEL_RATES = [
    ("gpt-4o-mini", 0.075 / 1_000_000, 0.300 / 1_000_000),
]
DEFAULT_MODEL = "gpt-4o-mini"

# ---------------------------------------------------------------------------
# FIXED VALUES — language gate
# ---------------------------------------------------------------------------
PRIMARY_LANGUAGE = "en"
COMMON_ENGLISH_WORDS = [
    "documentation", "docs", "api", "reference", "guide", "overview",
    "introduction", "getting started", "home", "index", "main",
]
LANGUAGE_MIN_LENGTH = 50       # shorter texts pass without classification
LANGUAGE_SAMPLE_CHARS = 1000   # classify the first 1,000 characters
TITLE_CHECK_MIN_CHARS = 50     # titles shorter than this are not checked
TITLE_MIN_LENGTH = 10          # min_length used when a title is checked

# ---------------------------------------------------------------------------
# FIXED VALUES — links
# ---------------------------------------------------------------------------
SKIP_HREF_PREFIXES = ["#", "mailto:", "tel:", "javascript:"]

# ---------------------------------------------------------------------------
# FIXED VALUES — code blocks
# ---------------------------------------------------------------------------
CODE_SELECTORS = [
    "pre code",
    ".highlight",
    ".prism-code",
    ".hljs",
    '[class*="language-"]',
    ".code-block",
    'div[class*="codeBlock"]',
    ".code",
    '[class*="code"]',
]
MIN_CODE_CHARS = 10
# main language -> accepted spellings
LANGUAGE_ALIASES = [
    ("python", ["python", "py", "python3", "pycon"]),
    ("javascript", ["javascript", "js", "jsx", "typescript", "ts",
                    "tsx", "react", "reactjs", "react-jsx", "react-tsx"]),
    ("nodejs", ["node", "nodejs", "node.js", "npm", "yarn"]),
]
# content hints, checked in this order; any hit overrides the class language
CONTENT_HINTS = [
    ("tsx", ["React", "jsx", "tsx", "<Component", "<div", "interface Props",
             "React.FC", "useState", "useEffect", "<>"]),
    ("jsx", ["React.", "jsx", "<div", "className=", "props.", "render()"]),
    ("typescript", ["interface", "type ", ": string", ": number", ": boolean"]),
]
KEPT_CODE_LANGUAGES = ["python", "javascript", "nodejs", "tsx"]
CODE_COMMENT_PREFIXES = ["//", "#", "/*", "*", "*/", "<!--", "-->"]
CODE_DELETIONS = ["var ", "let ", "const ", "def ", "async ", "await "]

# ---------------------------------------------------------------------------
# FIXED VALUES — de-duplication
# ---------------------------------------------------------------------------
SIMILARITY_THRESHOLD_PCT = 85   # Jaccard must be strictly greater than 0.85

# ---------------------------------------------------------------------------
# FIXED VALUES — generation temperatures
# ---------------------------------------------------------------------------
GENERATE_TEMPERATURE = 0.0
CRITIQUE_TEMPERATURE = 0.7
REFINE_TEMPERATURE = 0.3

# ---------------------------------------------------------------------------
# FIXED VALUES — output
# ---------------------------------------------------------------------------
BUNDLE_SUFFIX = "_documentation.md"
BUNDLE_BANNER = "<!-- Auto-generated documentation -->"
BUNDLE_TITLE = "Documentation"

# ---------------------------------------------------------------------------
# FIXED VALUES — prompts
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = """You are a technical documentation expert creating beautiful, structured markdown documentation. Follow these strict guidelines:

STRUCTURE:
1. Each document section must follow this format:
   ```markdown
   ## Section Title
   Brief overview of the section (1-2 sentences)

   ### Key Concepts
   - Concept 1: Brief explanation
   - Concept 2: Brief explanation

   ### Implementation
   Step-by-step guide or explanation

   ### Examples
   Practical examples with explanations
   ```

CONTENT RULES:
1. Every code block must have:
   - Title describing purpose
   - Language specification
   - Brief explanation before code
   - Comments for complex parts
   - Expected output (if applicable)

2. Installation instructions must include:
   - Prerequisites list
   - Step-by-step commands
   - Expected output
   - Troubleshooting notes

3. API documentation must show:
   - Method signature
   - Parameter descriptions
   - Return value details
   - Usage example
   - Common errors/solutions

FORMATTING:
1. Headers:
   - H1 (#) for document title
   - H2 (##) for main sections
   - H3 (###) for subsections
   - H4 (####) for example titles

2. Code blocks:
   ```language
   # Title: Purpose of code
   code here
   ```

3. Notes and warnings:
   > **Note:** Important information here

   > ⚠️ **Warning:** Critical warning here

4. Lists:
   - Use bullet points for related items
   - Use numbered lists for sequential steps

QUALITY REQUIREMENTS:
1. Every section must have:
   - Clear purpose
   - Practical examples
   - Implementation details
   - Common pitfalls/solutions

2. All content must be:
   - Concise but complete
   - Technically accurate
   - Well-structured
   - Easy to follow

3. Code examples must be:
   - Practical and realistic
   - Well-commented
   - Error-handled
   - Production-ready

NEVER INCLUDE:
- Marketing language
- Redundant information
- Unexplained jargon
- Incomplete examples
- Non-English content
- Raw HTML (use markdown)

ALWAYS:
1. Start with an overview
2. Include prerequisites
3. Show practical examples
4. Explain error scenarios
5. Add troubleshooting tips
6. Link related sections
7. Use consistent terminology"""

CRITIQUE_SYSTEM_PROMPT = """You are a technical documentation specialist with expertise in:
1. Technical writing and documentation standards
2. Code documentation best practices
3. API documentation requirements
4. Information architecture
5. Technical accuracy verification

Analyze the provided markdown documentation and provide a detailed critique focusing on:
1. Technical accuracy and completeness
2. Structure and organization
3. Clarity and readability
4. Code examples and their explanations
5. Missing or unclear information
6. Consistency in terminology
7. Documentation best practices

Format your critique in a structured way that can be used by another AI to make improvements."""

REFINE_SYSTEM_PROMPT = """You are a technical documentation editor with expertise in improving documentation based on expert critique.
Your task is to refine the provided markdown documentation using the critique provided.

Follow these guidelines:
1. Address all points raised in the critique
2. Maintain the original document's core information
3. Improve clarity and readability
4. Enhance technical accuracy
5. Ensure consistent terminology
6. Optimize structure and organization
7. Improve code examples and their explanations

Return the improved markdown content."""

USER_PROMPT_FORMAT = "Title: {title}\n\nContent: {content}"
CRITIQUE_USER_FORMAT = "Please analyze and critique this documentation:\n\n{content}"
REFINE_USER_FORMAT = ("Original content:\n\n{content}\n\nCritique:\n\n{critique}"
                      "\n\nPlease refine the content based on this critique.")

# Quality rules the generated markdown is audited against (from the prompt):
# required headings, fenced code with a language, no raw HTML.
AUDIT_HEADINGS = ["### Key Concepts", "### Implementation", "### Examples"]
