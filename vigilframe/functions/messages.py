"""Texts that appear in results."""

# Finding, label and advice texts, as stored and displayed.
NULL_IN_NOT_NULL = "NOT NULL 컬럼에 NULL 값 존재"
VERY_FEW_NULLS = "극소 NULL 감지"
FEW_NULLS = "소수 NULL 감지"
MANY_NULLS = "다수 NULL 감지"
DUPLICATE = "동일한 레코드가 {n}번 중복됨"
RARE_VALUE = "'{value}' 값이 {n}개({share}%)로 소수 카테고리"
UNKNOWN_METRIC = "알 수 없는 지표"
ITEM = "항목 {n}"
ALARM = "이상"
# Reasons for scores from 0.8, from 0.6, from 0.4 and below.
BANDS = [
    "매우 관련성 높음 - 핵심 테이블",
    "관련성 높음 - 주요 테이블",
    "관련성 보통 - 참고 테이블",
    "관련성 낮음 - 선택적 테이블",
]
# Registry advice: id, type, priority, title, description, link.
ADVICE = [
    (
        "perf_opt_{n}", "optimization", "high", "성능 최적화 필요",
        "최근 {n}개의 이상징후가 감지되었습니다. 시스템 성능 점검과 쿼리 최적화를 권장합니다.",
        "/optimization-guide",
    ),
    (
        "alert_setup_{n}", "alert_setup", "medium", "알림 설정 권장",
        "{n}개의 지표에 알림이 설정되지 않았습니다. 임계값 알림을 설정하여 문제를 조기에 감지하세요.",
        "/alert-setup",
    ),
    (
        "stale_metrics_{n}", "maintenance", "medium", "지표 점검 필요",
        "{n}개의 지표가 2시간 이상 업데이트되지 않았습니다. 스케줄러 상태를 확인해주세요.",
        "/metrics-health",
    ),
    (
        "add_more_metrics", "alert_setup", "low", "추가 지표 설정",
        "더 포괄적인 모니터링을 위해 추가 지표 설정을 권장합니다. 핵심 비즈니스 메트릭을 추가해보세요.",
        "/metric-setup",
    ),
]
