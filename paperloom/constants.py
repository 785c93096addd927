"""Word lists, symbol tables, patterns and thresholds that results depend on."""

# Headings recognised by keyword.
KEYWORD_HEADINGS = (
    "abstract", "introduction", "background", "related work", "methodology", "method", "methods", "approach",
    "experiment", "experiments", "experimental", "results", "discussion", "evaluation", "analysis", "implementation",
    "conclusion", "conclusions", "summary", "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements",
    "future work",
)

# Lines that carry publisher or page metadata (searched, not matched; (?i) where case is ignored).
METADATA_PATTERNS = (
    r"^\d+\s*$",
    r"^\d+\s+\d+\s*$",
    r"^\d+\s{5,}",
    r"(?i)^vol\.\s*\d+",
    r"(?i)^volume\s+[IVXLC\d]+",
    r"(?i)^doi:\s*",
    r"(?i)DOI:\s*10\.\d+",
    r"(?i)^\d{4}\s+(IEEE|ACM|Springer)",
    r"(?i)^©\s*\d{4}",
    r"(?i)ISSN\s*[\d-]+",
    r"(?i)^Authorized licensed use",
    r"(?i)^Proceedings of",
    r"^\d+-\d+-\d+-\d+",
    r"(?i)^arXiv:\d+\.\d+",
    r"(?i)^https?://",
    r"(?i)Page\s+\d+\s+of\s+\d+",
    r"(?i)Machine\s+Learning\s+\(\d{4}\)\s+\d+:\d+",
    r"(?i)^\d+\s+Page\s+\d+\s+of\s+\d+",
    r"(?i)^Acta\s+Avionica",
    r"(?i)Creative\s+Commons\s+Attribution",
    r"(?i)^Article\s+is\s+licensed\s+under",
    r"(?i)^Received\s+\d+.*accepted\s+\d+",
)

AFFILIATION_WORDS = ("university", "institute", "department", "college", "laboratory", "school", "center", "centre", "faculty")
STOP_WORDS = (
    "true", "false", "sin", "cos", "tan", "log", "exp", "max", "min", "flatten", "terms", "where", "with", "prior",
    "posterior", "prediction", "likelihood", "that", "this",
)
FEATURE_HEADINGS = ("abstract", "introduction", "conclusion", "references", "methods", "results", "discussion", "background")
FEATURE_SYMBOLS = "αβγδεζηθικλμνξπρστυφχψω∑∫∂∇±∞≈≠≤≥"

# Unicode to plain text, in order of application.
LIGATURES = (("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb00", "ff"), ("\ufb03", "ffi"), ("\ufb04", "ffl"))
UNICODE_FIXES = (
    ("\u2018", "`"), ("\u2019", "'"), ("\u201c", "``"), ("\u201d", "''"), ("\u2013", "--"), ("\u2014", "---"),
    ("\u2026", "..."), ("\u00a0", " "), ("\u200b", ""), ("\u00ad", ""), ("\uf0b7", "-"), ("\uf0a7", "-"),
    ("\uf0d8", "-"), ("\u2022", "-"), ("\u2023", "-"), ("\u25cf", "-"), ("\u25cb", "o"), ("\u25aa", "-"), ("\u25a0", "-"),
)

# Greek letters and the LaTeX commands that stand for them.
GREEK = (
    ("α", r"\alpha"), ("β", r"\beta"), ("γ", r"\gamma"), ("δ", r"\delta"), ("ε", r"\epsilon"), ("ζ", r"\zeta"),
    ("η", r"\eta"), ("θ", r"\theta"), ("ι", r"\iota"), ("κ", r"\kappa"), ("λ", r"\lambda"), ("μ", r"\mu"),
    ("ν", r"\nu"), ("ξ", r"\xi"), ("π", r"\pi"), ("ρ", r"\rho"), ("σ", r"\sigma"), ("τ", r"\tau"),
    ("υ", r"\upsilon"), ("φ", r"\phi"), ("χ", r"\chi"), ("ψ", r"\psi"), ("ω", r"\omega"), ("Γ", r"\Gamma"),
    ("Δ", r"\Delta"), ("Θ", r"\Theta"), ("Λ", r"\Lambda"), ("Ξ", r"\Xi"), ("Π", r"\Pi"), ("Σ", r"\Sigma"),
    ("Φ", r"\Phi"), ("Ψ", r"\Psi"), ("Ω", r"\Omega"),
)

# Mathematical symbols; commands already between dollar signs are not wrapped again.
SYMBOLS = (
    ("±", r"\pm"), ("∓", r"\mp"), ("×", r"\times"), ("÷", r"\div"), ("·", r"\cdot"), ("∞", r"\infty"),
    ("≈", r"\approx"), ("≠", r"\neq"), ("≤", r"\leq"), ("≥", r"\geq"), ("∈", r"\in"), ("∉", r"\notin"),
    ("⊂", r"\subset"), ("⊃", r"\supset"), ("∪", r"\cup"), ("∩", r"\cap"), ("∧", r"\wedge"), ("∨", r"\vee"),
    ("¬", r"\neg"), ("∀", r"\forall"), ("∃", r"\exists"), ("∅", r"\emptyset"), ("∇", r"\nabla"), ("∂", r"\partial"),
    ("√", r"\sqrt{}"), ("∫", r"\int"), ("∑", r"\sum"), ("∏", r"\prod"), ("→", r"\rightarrow"), ("←", r"\leftarrow"),
    ("⇒", r"\Rightarrow"), ("⇐", r"\Leftarrow"), ("↔", r"\leftrightarrow"), ("⇔", r"\Leftrightarrow"), ("°", r"\degree"),
    ("−", "-"), ("⊕", r"$\oplus$"), ("⊗", r"$\otimes$"), ("⊖", r"$\ominus$"), ("⊘", r"$\oslash$"), ("⊙", r"$\odot$"),
    ("∘", r"$\circ$"), ("⟨", r"$\langle$"), ("⟩", r"$\rangle$"), ("‖", r"\|"), ("′", "'"), ("″", "''"),
    ("∝", r"$\propto$"), ("∥", r"\|"), ("≡", r"$\equiv$"), ("≅", r"$\cong$"), ("≪", r"$\ll$"), ("≫", r"$\gg$"),
    ("⇑", r"$\Uparrow$"), ("⇓", r"$\Downarrow$"), ("↑", r"$\uparrow$"), ("↓", r"$\downarrow$"), ("⋆", r"$\star$"),
    ("□", r"$\square$"), ("†", r"$\dagger$"), ("‡", r"$\ddagger$"), ("§", r"\S{}"), ("¶", r"\P{}"), ("★", r"$\bigstar$"),
    ("✓", r"$\checkmark$"), ("✗", r"$\times$"), ("∼", r"$\sim$"), ("⊤", r"$\top$"), ("⊥", r"$\bot$"), ("⊢", r"$\vdash$"),
    ("⊣", r"$\dashv$"), ("∗", r"$*$"), ("ϕ", r"$\phi$"), ("ϵ", r"$\epsilon$"), ("ϑ", r"$\vartheta$"), ("ϱ", r"$\varrho$"),
    ("ϖ", r"$\varpi$"), ("ℓ", r"$\ell$"), ("ℝ", r"$\mathbb{R}$"), ("ℕ", r"$\mathbb{N}$"), ("ℤ", r"$\mathbb{Z}$"),
)

# Characters counted as mathematics.
MATH_CLASS = "[\u0391-\u03c9\u2200-\u22ff\u2190-\u21ff\u2070-\u209f±×÷¬ϕϵϑϱϖ⟨⟩‖′″]"
SUPERSCRIPTS, SUPERSCRIPT_VALUES = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼ⁿ", "0123456789+-=n"
SUBSCRIPTS, SUBSCRIPT_VALUES = "₀₁₂₃₄₅₆₇₈₉₊₋₌", "0123456789+-="

OCR_BLOCK, OCR_CELL, OCR_RENDER = 0.60, 0.40, 0.60
PER_PAGE, PER_DOCUMENT = 6, 20

# Substrings that make a medium-length formula untrustworthy.
SUSPICIOUS_LATEX = (
    r"\underbrace", r"\overbrace", r"\stackrel", r"\Longleftrightarrow", r"\Longrightarrow", r"\hookrightarrow", r"\bigwedge",
    r"\bigvee", r"\mathcal{C}", r"\mathcal{D}", r"\sin\theta", r"\not=", r"\not{",
)

# Scores of recognised formulas: arrows (each one counts), words of prose, and what else raises or lowers a score.
ARROWS = (r"\rightarrow", r"\leftrightarrow", r"\longleftrightarrow", r"\Leftrightarrow", r"\Longleftrightarrow", r"\longrightarrow", r"\Longrightarrow", r"\hookrightarrow", r"\Rightarrow")
SCORE_GARBAGE = ("pout", "REFERENCES", "References", "Abstract", "Keywords", "Introduction", "equation")
SCORE_REWARDS = (r"\frac", r"\int", r"\sum", r"\prod", r"\lim", "^{", "_{", r"\alpha", r"\beta", r"\partial", r"\sqrt", r"\infty", r"\pi", r"\sigma", r"\omega")
SCORE_CONTAINED = (
    (r"\Xi", -0.1), (r"\Upsilon", -0.1), (r"\Digamma", -0.1), ("↔", -0.15), ("→", -0.15), ("←", -0.15), ("⟶", -0.15), ("⟵", -0.15), ("⟷", -0.15),
    (r"\div", -0.15), (r"\varrho", -0.15), *((s, 0.05) for s in SCORE_REWARDS),
)
SCORE_PATTERNS = (
    (r"\{[A-Za-z]\}\\?(to|leftrightarrow|rightarrow|longrightarrow)", -0.2), (r"\(\s*,", -0.2), (r"\\frac\{[01]\}\{[01]\}", -0.15),
    (r"\\frac\{[^}]*\\?(?:ldots|cdots|dots|\.\.\.).*?\}", -0.2), (r"\\hat\{\\[a-zA-Z]+\}", -0.15), (r"_\{?\d{3,}\}?", -0.15), (r"[+\-=<>]", 0.05),
)

# Layout name: document class and bibliography style of its references.
LAYOUTS = {
    "ieee": (r"\documentclass[conference]{IEEEtran}", "thebibliography"), "acm": (r"\documentclass{article}", "thebibliography"),
    "springer": (r"\documentclass{llncs}", "thebibliography"), "elsevier": (r"\documentclass{elsarticle}", "thebibliography"),
    "apa": (r"\documentclass{article}", "enumerate"), "arxiv": (r"\documentclass{article}", "thebibliography"),
}

# Packages that the environments need.
PREAMBLE = "\n".join(f"\\usepackage{p}" for p in ("[T1]{fontenc}", "[utf8]{inputenc}", "{amsmath,amssymb}", "{graphicx}", "[export]{adjustbox}", "{xcolor}", "{url}"))

# Symbols that make a line an equation's context, and those that a numbered equation holds.
CONTEXT_SYMBOLS = "≤≥≠≈∈∉⊂⊃∪∩∧∨¬∀∃∅∇∂√∫∑∏±×÷→←↔⊤⊥⊕⊗∼"
EQUATION_SYMBOLS = "αβγδεζηθικλμνξπρσςτυφχψωΓΔΘΛΞΠΣΦΨΩ∼≈≠≤≥∈∉⊂⊃∪∩∧∨¬∀∃∅∇∂√∫∑∏±×÷→←↔⊤⊥⊕⊗"

# Words that look like a letter with indices.
SUBSCRIPT_WORDS = (
    "aim", "air", "all", "ami", "ask", "nil", "sir", "ski", "slim", "sin", "kin", "pin", "rim", "pis", "sim", "lip",
    "rip", "sip", "inn", "ink", "ill", "iris", "mini", "kiss", "miss", "risk", "skip", "skin", "spin", "slip", "grin",
    "grip", "trim", "trip", "milk", "silk", "kill", "fill", "pill", "till", "will", "mill", "hill", "bill",
)
SHORT_WORDS = (
    "an", "am", "in", "on", "up", "if", "is", "it", "ok", "no", "so", "to", "we", "he", "me", "be", "or", "at", "of",
    "as", "by", "do", "go", "hi", "mi",
)

# Fonts of mathematics, and limits of a formula region.
MATH_FONTS = ("cmex", "cmsy", "cmmi", "euler", "mathit", "mathsy")
MIN_MATH, MIN_MATH_SHARE, MAX_REGION_CHARS, MIN_REGION_W, MIN_REGION_H = 5, 0.08, 300, 60, 20

# Lines of a reference list that are no reference: headers, licences, addresses, numbers.
JUNK_REFERENCES = (
    r"(?i)^[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z.]+$",
    r"^\d+(\s+\d+)?$",
    r"(?i)creative\s+commons",
    r"(?i)article\s+is\s+licensed\s+under",
    r"(?i)received\s+\d+.*accepted\s+\d+",
    r"(?i)^(publisher's note|springer nature|exclusive rights|manu script version|author self-archiving|page |machine learning)",
    r"(?i)^(volume|vol\.?|issue|no\.?)\s",
    r"(?i)page\s+\d+\s+of\s+\d+",
    r"(?i)^\d+\s+page\s+\d+",
    r"^\d+\s+(University|Institute|Department|Lab|School|Vector|Noah)",
)
# Entries that are a name and an e-mail address.
ADDRESS_REFERENCES = (r"^[A-Za-z0-9_.+-]+\s+[a-z0-9_.+-]+@", r"^[A-Z][a-z]+ [A-Z][a-z]+\s+[a-z0-9_.+-]+@")
# The beginning of a reference by surname and initials, and of a line that is none.
CITED_SURNAME = r"^[A-Z][a-zÀ-ÿ]+(?:[-'][A-Z][a-zÀ-ÿ]+)?,\s+[A-Z]\."
PLAIN_SURNAME = r"^[A-Z][a-z]+,\s+[A-Z]\."
GOES_ON = ("pp.", "In:", "In ", "arXiv", "&", "and ")
CITED_YEAR = r"\(\d{4}[a-z]?\)"

# Tables in running text: marks, captions, numbers, names of data sets, words of sentences, bad headers.
TABLE_MARKS = "⇑⇓↑↓†‡§*⁺⁻"
TABLE_CAPTION = r"(?i)^Table\s+(\d+)\b[.\s]*(.*)"
TABLE_NUMBER = r"^[\d.\-+±e]+[⇑⇓↑↓†‡§*]*$"
DATASETS = (
    "Skillcraft", "SML", "Parkinsons", "Bike", "CCPP", "CIFAR", "MNIST", "ImageNet", "SVHN", "Fashion", "STL", "Caltech",
    "Reuters", "AG.News", "DBPedia", "Amazon", "Yelp",
)
SENTENCE_WORDS = (
    "the", "a", "an", "and", "or", "is", "are", "was", "were", "to", "of", "in", "for", "with", "on", "at", "by", "from",
    "that", "this", "it", "not", "we", "our", "be", "as", "has", "have", "had", "but", "if", "than", "its", "all", "can",
    "will", "which", "their", "more", "also", "only", "denote", "reported", "setting", "results", "worse", "better",
    "significantly", "respectively", "similarly",
)
BAD_HEADERS = (
    "the", "a", "an", "we", "and", "or", "is", "are", "to", "of", "in", "for", "with", "on", "at", "by", "from", "that",
    "this", "them", "then", "also", "only",
)
# What a caption loses, in order.
CAPTION_REST = ((r"\s*[⇑⇓↑↓]+\s*", " "), (r"\s*,\s*,\s*,?\s*and\s+$", ""), (r"(?i)\s+and\s+denote\s+(sig|significantly).*$", ""), (r"\s{2,}", " "))
# What tables leave in bodies (each line alone where anchored), besides the tables' own captions and rows.
TABLE_RESIDUE = (
    r"(?m)^[⇑⇓↑↓\s]+$",
    r"(?m)^similarly\s*$",
    r"(?mi)^similarly\s+to\s+Table\s+\d+\s*$",
    r"(?m)Train/test\s+size.*$",
    r"(?m)corr-coef.*$",
    r"(?m)^#[Cc]lients?\s*$",
    r"(?m)^#[Cc]lients?\s+\d+.*$",
    r"(?m)^Central\s+GP\s+[\d.\s]+$",
    r"(?m)^(Local\+local|Local\+global|Avg\+local|kd\+local)\b.*$",
    r"(?mi)^ours\s*$",
    r"(?m)^[\d.\s⇑⇓↑↓†‡§*±,/]+$",
    r"(?m)^p\s*<\s*\.\s*p\s*<\s*\.?\s*$",
    r"(?m)^[−\-–\s]+$",
    r"(?m)^nificantly\s+worse\s+results.*$",
    r"(?m)^results\s+similarly\s*$",
    r"(?m)^similarly\s+to\s*$",
    r"(?m)^ECE\s+reported\s+for\s+the\s+.*setting\..*$",
    r"(?m)^.*denote\s+significantly\s+(worse|better)\s+results.*$",
    r"(?m)^\s*p\s*<\s*0?\s*\.?\s*0[15]\s*$",
    r"(?m)^\d+/\d+(\s+\d+/\d+)+\s*$",
)
