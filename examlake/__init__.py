"""examlake: question-bank analytics as DataFrame -> DataFrame operators on Spark."""
