"""grainscope: image-forensics statistics, corpora and detector evaluation as Spark jobs."""
