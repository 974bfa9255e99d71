"""Fixed labels and column names."""

from __future__ import annotations

RESISTANT, SUSCEPTIBLE, INTERMEDIATE = "Resistant", "Susceptible", "Intermediate"
PHENOTYPES = (RESISTANT, SUSCEPTIBLE)

#: Dotted names that metadata files use, and what they are called here.
METADATA_NAMES = {
    "genome.genome_id": "genome_id",
    "genome_drug.resistant_phenotype": "phenotype",
    "genome_drug.antibiotic": "antibiotic",
}

#: Singular and plural names of feature types.
FEATURE_TYPES = {"gene": "genes", "protein": "proteins", "domain": "domains", "arg": "args", "struct": "struct"}

STRATA = {"year": "year_bin", "country": "country_abbr"}
SEED = 5280
