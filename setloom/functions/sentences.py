"""Sentences and sentence parts of the output tables."""

# Their wording is part of the result.
NEW_ASSAY_1 = "Replicate enhancer validation"
NEW_ASSAY_2 = "Profile driver genes"
OTHER_PROGRAMS = "Consider alternate regulatory programs."
FOLLOWS_GENES = " shift follows its leading-edge genes."
SUPPORTS_RESPONSE = " activity supporting this response."
FITS_THEME = " program consistent with the theme."
ASSAY_MARKS = "Profile enhancer marks at key leading-edge genes"
ASSAY_ATLAS = "Cross-check helper program in matched atlas"
OTHER_REGULATORS = "Consider alternate regulators if enhancer data remain weak."
TWO_SNIPPETS = "Two or more specific evidence snippets available."
ONE_SNIPPET = "Single evidence snippet available."
NO_SNIPPET = "No evidence snippets provided."
NO_CRITIC = "Critic unavailable; treat cautiously."
DRIVEN_BY = " shift is driven by genes such as "
FOLLOWS_SHIFT = " follows the observed shift"
LINKED_ACTIVITY = " activity linked to this response."
RETAINED = " shift is retained via leading-edge genes ("
CONCENTRATES = " signal concentrates in sets such as "
FITS_DIRECTION = " module consistent with this direction."
NO_HELPER_QC = "No helper cleared QC; interpretation falls back to leading-edge genes and background expectations."
ASSAY_ACTIVATION = "Profile key leading-edge genes for enhancer activation"
SWAPPED = "Deterministic swap pending enhancer confirmation."
NO_HELPER_GATES = "No helper cleared revision gates; relying on leading-edge genes."
AWAIT = "Await direct enhancer validation or motif rescue experiment."
ASSAY_REVERSAL = "Test whether the highlighted process reverses when perturbation is removed."
NOT_IN_TABLE = "Cell type absent from ESEA table."
NO_DIRECTION = "Unable to assess direction for claimed "
MEETS = " meets thresholds."
BORDERLINE = " is borderline; treat cautiously."
ALIGNS = ") aligns with "
HELPER_Q = "; helper q-values "
Q_PENDING = "pending enhancer screen"
