"""Label and genre domains, prices, token estimates and prompt texts.

Everything in this module is data that results depend on; behaviour lives elsewhere.
"""

from __future__ import annotations

# --- fixed values: label and genre domains -------------------------------------------------

LABELS = ["entailment", "neutral", "contradiction"]
LABEL_BY_ID = {0: "entailment", 1: "neutral", 2: "contradiction"}
UNKNOWN_LABEL = "unknown"
# Class order of the second (encoder) scorer; differs from LABEL_BY_ID.
ENCODER_LABEL_BY_ID = {0: "contradiction", 1: "entailment", 2: "neutral"}
# Order in which a response is searched for a label.
PARSE_ORDER = ["entailment", "contradiction", "neutral"]
PARSE_STEMS = {"entail": "entailment", "contradict": "contradiction"}

GENRES = [
    "fiction", "government", "slate", "telephone", "travel",
    "facetoface", "letters", "nineeleven", "oup", "verbatim",
]
HYBRID_GENRES = ["government", "oup"]

# --- fixed values: features ----------------------------------------------------------------

NEGATIONS = ["not", "never", "no", "neither", "nor"]

MODEL_FEATURES = [
    "premise_length", "hypothesis_length", "combined_length", "length_ratio",
    "premise_negations", "hypothesis_negations", "total_negations",
    "jaccard_similarity", "hypothesis_overlap", "premise_coverage", "shared_words",
]
FEATURES = MODEL_FEATURES + ["char_length", "lexical_overlap"]

# --- fixed values: strategies, token estimates, prices ---------------------------------------

BASE_STRATEGIES = ["zero-shot", "one-shot", "few-shot", "cot"]
STRATEGIES = BASE_STRATEGIES + ["6-shot", "6-shot-cot"]
STRATEGY_ALIASES = {"chain-of-thought": "cot"}

ROUTER_TOKENS = {"zero-shot": 165, "one-shot": 235, "few-shot": 465, "cot": 500}
REPLAY_TOKENS = {"zero-shot": 165, "one-shot": 235, "few-shot": 465, "cot": 600}
COST_TOKENS = {
    "zero-shot": (150, 15),
    "one-shot": (220, 15),
    "few-shot": (450, 15),
    "cot": (350, 150),
}
COST_TOKENS_DEFAULT = (200, 50)
PLANNED_PROMPT_TOKENS = {"zero-shot": 150, "one-shot": 220, "few-shot": 450, "cot": 350}
PLANNED_PROMPT_DEFAULT = 200
PLANNED_RESPONSE_TOKENS = 50
PLANNED_PRICE_INPUT_PER_1K = 0.000125
PLANNED_PRICE_OUTPUT_PER_1K = 0.000375

# USD per 1000 tokens: (input, output)
PRICES = {
    "gemini-1.5-flash": (0.000075, 0.0003),
    "gemini-1.5-pro": (0.00125, 0.005),
    "gpt-4o": (0.005, 0.015),
    "gpt-4o-mini": (0.00015, 0.0006),
}
DEFAULT_MODEL = "gemini-1.5-flash"

ROI_FALLBACK_TOKENS = 500
ROI_USD_PER_TOKEN = 0.0000003

# Response limits: the study uses the substring rule, the adaptive run the per-strategy table.
STUDY_LIMIT_COT = 600
STUDY_LIMIT_PLAIN = 20
ADAPTIVE_LIMITS = {"6-shot": 20, "6-shot-cot": 500}
ADAPTIVE_LIMIT_DEFAULT = 20

RETRYABLE_ERRORS = ["rate limit", "timeout", "unavailable"]

CHI2_1DF_95 = 3.841458820694124

# --- fixed values: stop words of the full tokeniser (public English list, 179 words) ----------

STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at "
    "by for with about against between into through during before after above below to from up down "
    "in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn "
    "doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# --- fixed values: word and substring lists of the rule labeler --------------------------------

LABELER_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may "
    "might must shall can need dare ought used to of in for on with at by from as into through during "
    "before after above below between under again further then once here there when where why how all "
    "each few more most other some such no nor not only own same so than too very s t just don now and or"
).split()
LABELER_NEGATION_SUBSTRINGS = ["not", "n't", "never", "no ", "none"]

# --- fixed values: prompt texts ----------------------------------------------------------------

SYSTEM_INSTRUCTION = """You are an expert in Natural Language Inference (NLI). Your task is to classify the logical relationship between a premise and a hypothesis.

The possible classifications are:
- **entailment**: The hypothesis logically follows from the premise. If the premise is true, the hypothesis must also be true.
- **contradiction**: The hypothesis contradicts the premise. The premise and hypothesis cannot both be true.
- **neutral**: The hypothesis is neither entailed by nor contradicts the premise. The premise does not provide enough information to determine the truth of the hypothesis.

You must respond with exactly one word: entailment, contradiction, or neutral."""

ZERO_SHOT_TEXT = """{system_instruction}

Premise: {premise}
Hypothesis: {hypothesis}

Classification:"""

ONE_SHOT_TEXT = """{system_instruction}

Here is an example:

Premise: The cat sat on the mat in the living room.
Hypothesis: An animal is in a room inside a house.
Classification: entailment

Now classify this pair:

Premise: {premise}
Hypothesis: {hypothesis}

Classification:"""

FEW_SHOT_HEADER = """{system_instruction}

Here are some examples:

"""

FEW_SHOT_EXAMPLE = """Premise: {premise}
Hypothesis: {hypothesis}
Classification: {label}

"""

FEW_SHOT_FOOTER = """Now classify this pair:

Premise: {premise}
Hypothesis: {hypothesis}

Classification:"""

COT_TEXT = """You are an expert in Natural Language Inference (NLI). Your task is to classify the logical relationship between a premise and a hypothesis.

The possible classifications are:
- **entailment**: The hypothesis logically follows from the premise.
- **contradiction**: The hypothesis contradicts the premise.
- **neutral**: The hypothesis is neither entailed by nor contradicts the premise.

Please think step-by-step:
1. Identify the key claims in the premise
2. Identify the key claims in the hypothesis
3. Compare the claims and check for logical relationships
4. Determine if the hypothesis is entailed, contradicted, or neutral

Premise: {premise}
Hypothesis: {hypothesis}

Let me analyze this step by step:"""

# The two trailing blanks after "contradicts the premise." are part of the text.
COT_WITH_EXAMPLE_TEXT = """You are an expert in Natural Language Inference (NLI). Your task is to classify the logical relationship between a premise and a hypothesis.

The possible classifications are:
- **entailment**: The hypothesis logically follows from the premise.
- **contradiction**: The hypothesis contradicts the premise.  
- **neutral**: The hypothesis is neither entailed by nor contradicts the premise.

Here is an example of step-by-step reasoning:

Premise: The company reported record profits in the third quarter, exceeding analyst expectations.
Hypothesis: The company lost money in the third quarter.

Step-by-step analysis:
1. Key claims in premise: The company had "record profits" and "exceeded expectations" in Q3.
2. Key claims in hypothesis: The company "lost money" in Q3.
3. Comparison: "Record profits" directly contradicts "lost money" - these cannot both be true.
4. Conclusion: The hypothesis contradicts the premise.

Classification: contradiction

---

Now analyze this pair:

Premise: {premise}
Hypothesis: {hypothesis}

Let me analyze this step by step:"""

SIX_SHOT_COT_TEXT = """{system_instruction}

Here are some examples of step-by-step reasoning:

---
Premise: The cat sat on the mat.
Hypothesis: The cat is on the mat.
Analysis: 
1. Premise says cat sat on mat. 
2. Hypothesis says cat is on mat. 
3. Sitting on mat implies being on the mat.
Classification: entailment

---
Premise: I have no money.
Hypothesis: I am a millionaire.
Analysis:
1. Premise says no money.
2. Hypothesis says millionaire.
3. Having no money directly contradicts being a millionaire.
Classification: contradiction

---
Now analyze this pair step-by-step:

Premise: {premise}
Hypothesis: {hypothesis}

Let me analyze this step by step:"""

# (premise, hypothesis, label)
FEW_SHOT_EXAMPLES = [
    ("The children were playing soccer in the park on a sunny afternoon.",
     "Some young people were engaged in outdoor physical activity.",
     "entailment"),
    ("The restaurant was completely empty when we arrived at noon.",
     "The restaurant was crowded with customers at lunchtime.",
     "contradiction"),
    ("The scientist published her research findings in a prestigious journal.",
     "The scientist won an award for her work.",
     "neutral"),
    ("All employees must complete the mandatory training by Friday.",
     "There is a training deadline for workers.",
     "entailment"),
    ("The museum is closed on Mondays for maintenance.",
     "The museum welcomes visitors every day of the week.",
     "contradiction"),
    ("The new smartphone features a high-resolution camera and 5G connectivity.",
     "The smartphone is the best-selling model this year.",
     "neutral"),
]
FEW_SHOT_DEFAULT_COUNT = 5
