"""Panel factor research on Spark: operators, preparation, scoring, selection and combination."""
