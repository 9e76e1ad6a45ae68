"""Limits, defaults and sentences of the service being modelled.

Fixed values: results depend on them, so they are stated as they are.
"""

MAX_UPLOAD_BYTES = 26_214_400
MAX_DURATION_SECONDS = 900
VECTOR_WIDTH = 768
TRANSCRIPT_HITS = 5
CHAT_HITS = 3
HISTORY_PAGE = 5
CHUNK_WORDS = 140
TYPICAL_CHUNKS = (9, 12)
CLEAN_ATTEMPTS = 3
ANSWER_ATTEMPTS = 2
SLICE = "10 minutes"
PAUSE = "30 minutes"

NO_SESSION_JOB = "default"

STATUS_OPEN = "in-progress"
STATUS_DONE = "completed"

FILLERS = ("you know", "like", "um", "uh", "ah")

NO_TRANSCRIPT = "No transcription available for this session yet."
NO_SNIPPETS = "No specific meeting transcriptions were found for this query."
NO_CHATS = "No specific chat history was found for this query."
NO_ANSWER = (
    "I apologize, but I couldn't generate a response at this time."
    " Please try again later."
)
ANSWER_ERROR = (
    "I apologize, but an error occurred while processing your request."
    " Please try again later."
)
