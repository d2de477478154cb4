"""Coursework analytics as Spark jobs: question banks, study logs, review
schedules, retrieval chunks, grader checks, course lint and numeric practice."""
