"""The rewrite kernel: plain Python over one text, without Spark."""
