"""The prompt texts. Models were tuned on these bytes, so blanks and line ends count."""

# -- prefixes of the sequence-to-sequence family ---------------------------------------------------

TRANSLATE = "translate English natural language statements into first-order logic (FOL): "
TRANSLATE_USING = (
    "translate English natural language statements into first-order logic (FOL) "
    "using only the following predicates:\n"
)
EXTRACT = "extract predicates from English natural language statements for translating into first-order logic (FOL): "
EXTRACT_NO_BLANK = (
    "extract predicates from English natural language statements for translating into first-order logic (FOL):"
)

# -- system messages, one-line form ----------------------------------------------------------------

ROLE = (
    "You are a helpful AI assistant that translates Natural Language (NL) text in First-Order Logic (FOL) "
    "using only the given quantors and junctors:"
)
SYMBOLS = (
    "∀ (for all), ∃ (there exists), ¬ (not), ∧ (and), ∨ (or), → (implies), ↔ (if and only if), ⊕ (xor)."
)
ANSWER = "Start your answer with '𝜙=' followed by the FOL-formula. Do not include any other text."
USING = "Use only the following predicates:"
EXTRACT_ROLE = (
    "You are a helpful AI assistant that extracts predicates from Natural Language (NL) text "
    "for translating into First-Order Logic (FOL):"
)
EXTRACT_ANSWER = (
    "Start your answer with 'Predicates=[' followed by the predicates in alphabetical order "
    "followed by ']'. Do not include any other text."
)

SYSTEM = ROLE + SYMBOLS + ANSWER
SYSTEM_USING_HEAD = ROLE + SYMBOLS + USING
SYSTEM_EXTRACT = EXTRACT_ROLE + EXTRACT_ANSWER

# -- system messages, indented form (28 blanks before each further line) ---------------------------

INDENT = "\n" + " " * 28
SYSTEM_INDENTED = ROLE + INDENT + SYMBOLS + INDENT + ANSWER
# The code fragment inside this text is part of what was sent.
SYSTEM_INDENTED_USING_HEAD = ROLE + INDENT + SYMBOLS + INDENT + USING + "\"+f'Predicates=["
SYSTEM_INDENTED_USING_TAIL = "]" + INDENT + ANSWER
SYSTEM_INDENTED_EXTRACT = EXTRACT_ROLE + INDENT + EXTRACT_ANSWER

# -- worked examples of the few-shot family --------------------------------------------------------

EXAMPLE_1_NL = (
    "Here are some examples: -An energy-efficient building that incorporates renewable energy systems, "
    "sustainable materials, and innovative design strategies reduces its environmental impact and "
    'operating costs."  \n'
)
EXAMPLE_1_FOL = (
    "->𝜙=∀x∀y∀z (EnergyEfficientBuilding(x) ∧ RenewableEnergySystems(y) ∧ SustainableMaterials(z) ∧ "
    "InnovativeDesignStrategies(x) ∧ Incorporates(x, y, z) → "
    "(ReducesEnvironmentalImpact(x) ∧ ReducesOperatingCosts(x)))  \n"
)
EXAMPLE_2 = (
    '   - "An event can be indoors, outdoors, or virtual, but not all three options."  \n'
    "     ->𝜙=∃x (Event(x) ∧ ((Indoors(x) ∧ Outdoors(x) ∧ ¬Virtual(x)) ∨ "
    "(Indoors(x) ∧ ¬Outdoors(x) ∧ Virtual(x)) ∨ (¬Indoors(x) ∧ Outdoors(x) ∧ Virtual(x))))\n"
)
EXAMPLE_3 = (
    '   - "No artist who admires all designers is praised by any individual.\n'
    "     ->∀x (Artist(x) → ∀y ((Designer(y) → Admire(x, y)) → ¬∃z (Individual(z) ∧ Praise(z, x))))"
)
EXAMPLES = EXAMPLE_1_NL + " " * 5 + EXAMPLE_1_FOL + EXAMPLE_2 + EXAMPLE_3
EXAMPLES_ONE_BLANK = EXAMPLE_1_NL + " " + EXAMPLE_1_FOL + EXAMPLE_2 + EXAMPLE_3

FEW_SHOT = ROLE + SYMBOLS + EXAMPLES + ANSWER
FEW_SHOT_USING_HEAD = ROLE + SYMBOLS + EXAMPLES_ONE_BLANK + USING
FEW_SHOT_REASONING_HEAD = ROLE + " " + SYMBOLS + " " + EXAMPLES
EARLIER_THOUGHTS = "Use your earlier thoughts on this: "

# -- premise chain ---------------------------------------------------------------------------------

CHAIN_SYSTEM = (
    "You are a helpful AI assistant that translates Natural Language (NL) text into First-Order Logic (FOL) "
    "formulas for use in an automated theorem prover. "
    "Use only the given quantors and junctors: " + SYMBOLS + " "
    "Use consistent predicate and function names across all formulas. "
    "Use previously introduced predicate and function names when applicable, to ensure consistency for "
    "theorem proving. "
    "Start your answer with '𝜙=' followed by the FOL formula. Do not include any other text."
)
CHAIN_HEADER = "Previously translated premises in FOL:\n"

# -- prover input file -----------------------------------------------------------------------------

PROVER_HEADER = (
    "set(prolog_style_variables).\nset(auto_denials).\nclear(print_initial_clauses).\n"
    "clear(print_kept).\nclear(print_given).\n\nformulas(assumptions).\n"
)
PROVER_GOALS = "end_of_list.\n\nformulas(goals).\n"
PROVER_FOOTER = "end_of_list."
