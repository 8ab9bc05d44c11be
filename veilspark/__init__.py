"""veilspark: redaction analytics (detections, tracks, identities, audio ranges) as Spark DataFrames."""
