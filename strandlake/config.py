"""Configuration of a run: read from YAML, checked, with defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

REQUIRED = {
    "samples_file": str, "directory_loc": str, "reference_genome": str, "output_dir": str, "threads": int, "file_type": str,
    "chrom": str, "start_bp": int, "end_bp": int, "output_file_type": str,
}
FILES = ("samples_file", "reference_genome")

#: Defaults of each step; a missing one is filled in with a warning.
STEPS: dict[str, dict] = {
    "index": {},
    "count_reads": {"output_file_prefix": "read_counts", "min_mapq": 1},
    "mosdepth": {"output_file_prefix": "depth", "bin_size": 1000, "mode": "fast"},
    "normalize": {"output_file_prefix": "normalized", "min_depth": 20, "max_depth": 100, "top_frac": 0.1, "scope": "region"},
    "neighbors": {"output_file_prefix": "neighbor_coverage", "num_neighbors": 500, "zmax": 2.0, "sigma2_max": 1000.0, "frac_r": 1.0},
    "compute_diploid_genotypes": {"output_file_prefix": "diploid", "n_nbr": 300},
    "compute_haploid_genotypes": {
        "output_file_prefix": "haploid_genotypes", "method": "ibs", "min_neighbors": 1, "max_neighbors": 10, "n_iters": 100,
        "weighted": False, "weight_scale": 1_000_000, "min_length": 0.5, "min_match": 0.7, "iteration": "gauss_seidel",
    },
    "exon_genotypes": {"output_file_prefix": "exon", "n_nbr": 200},
}
STEP_REQUIRED = {"count_reads": {"flags": list}, "normalize": {"repeat_mask_file": str}, "compute_haploid_genotypes": {"neighbor_file": str}, "exon_genotypes": {"exon_counts_file": str}}

#: Steps that may also stand inside another one, and the names that the haploid step's input has by method.
INSIDE = {"normalize": "mosdepth", "neighbors": "mosdepth"}
INPUT_OF_METHOD = {"ibs": "ibs_output", "ibd": "ibd_output"}
#: Further names that are known, at the top and in steps.
KNOWN_TOP = ("min_mapq",)
KNOWN = {
    "index": ("output_file_prefix",), "count_reads": ("flags", "alignments"), "mosdepth": ("work_dir", "region_name", "remove_intermediate", *INSIDE), "normalize": ("repeat_mask_file",), "neighbors": (),
    "compute_diploid_genotypes": (), "compute_haploid_genotypes": ("neighbor_file", *INPUT_OF_METHOD.values()), "exon_genotypes": ("exon_counts_file",),
}


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass
class Config:
    values: dict

    @classmethod
    def read(cls, path: str) -> Config:
        import yaml

        with open(path) as f:
            return cls(yaml.safe_load(f) or {})

    def section(self, step: str) -> dict:
        """What is set for a step, inside the step that holds it or at the top; the haploid step's input by any name."""
        holder = self.values.get(INSIDE.get(step, "")) or {}
        own = (holder.get(step) if isinstance(holder, dict) else None) or self.values.get(step) or {}
        own = dict(own) if isinstance(own, dict) else {}
        if step == "compute_haploid_genotypes" and own.get("neighbor_file") is None:
            given = own.get(INPUT_OF_METHOD.get(str(own.get("method") or STEPS[step]["method"]).lower(), ""))
            own |= {"neighbor_file": given} if given is not None else {}
        return own

    def enabled(self, step: str) -> bool:
        return self.section(step).get("run") is True

    def step(self, name: str) -> dict:
        """A step's values over its defaults; min_mapq may also stand at the top, and depth files lie in the output folder
        unless said otherwise."""
        given = self.section(name)
        own = {**STEPS[name], **{k: v for k, v in given.items() if v is not None}}
        if name == "count_reads" and "min_mapq" not in given and "min_mapq" in self.values:
            own["min_mapq"] = self.values["min_mapq"]
        if name == "mosdepth":
            own.setdefault("work_dir", f"{self.values.get('output_dir', '.')}/mosdepth_workdir")
        return own

    def flags(self) -> list[int]:
        return [f for f in self.section("count_reads").get("flags") or [] if f is not None]

    def unknown(self) -> list[str]:
        """Names that no step reads."""
        out = [k for k in self.values if k not in REQUIRED and k not in STEPS and k not in KNOWN_TOP]
        for step, defaults in STEPS.items():
            out += [f"{step}.{k}" for k in self.section(step) if k != "run" and k not in defaults and k not in KNOWN[step]]
        return out

    def validate(self) -> Report:
        """Missing or mistyped fields and missing files are errors; in steps that run, missing defaults are warnings."""
        out = Report()
        for name, kind in REQUIRED.items():
            value = self.values.get(name)
            if value is None:
                out.errors.append(f"missing field: {name}")
            elif not isinstance(value, kind) or isinstance(value, bool):
                out.errors.append(f"{name} should be {kind.__name__}")
            elif name in FILES and not os.path.exists(value):
                out.errors.append(f"{name}: no such file: {value}")
        for step, defaults in STEPS.items():
            if not self.enabled(step):
                continue
            own = self.section(step)
            for name, kind in STEP_REQUIRED.get(step, {}).items():
                if not isinstance(own.get(name), kind):
                    out.errors.append(f"{step}.{name} is required")
                elif name.endswith("_file") and not os.path.exists(own[name]):
                    out.errors.append(f"{step}.{name}: no such file: {own[name]}")
            for name, default in defaults.items():
                if name not in own:
                    out.warnings.append(f"{step}.{name} not set, using {default}")
                elif default is not None and not isinstance(own[name], (type(default), int) if isinstance(default, float) else type(default)):
                    out.errors.append(f"{step}.{name} should be {type(default).__name__}")
        out.warnings += [f"{name} is not known and has no effect" for name in self.unknown()]
        return out
